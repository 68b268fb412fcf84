import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from histscore.llm import bitplanes as B
from histscore.llm import packing as K
from histscore.llm import tokens as T
from tests.llm.helpers import no_docs, odd_docs, odd_rows, real_docs

ODD = list("ab'sé9 \n\t\x0b\r\x1c\x85\xa0 　́.!?ZÀßΣ\U0001f600​日本 ")


def library(name):
    t = Tokenizer.from_file(T.tokenizer_path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, cut", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_pieces_give_the_librarys_ids(name, cut, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += [x["text"] for x in real_docs()[:50]] + [None, "a" * 5000, "don't we'll I'M it's 'tis ''s"]
    whole = library(name)
    want = [np.array(whole(t), "<u4").tobytes() for t in texts]
    assert T.Encoder(T.tokenizer_path(name), cut).encode(texts) == want
    monkeypatch.setattr(T, "KEPT", 8000)
    small = T.Encoder(T.tokenizer_path(name), cut)
    assert [x for k in range(0, len(texts), 97) for x in small.encode(texts[k : k + 97])] == want


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(1)
    docs = [(k if k % 7 else None, rng.integers(0, 1 << (1 + k % 31), k * 37 % 900, dtype=np.uint32)) for k in range(60)]
    sink = io.BytesIO()
    w = B.PlaneWriter(sink, planes, block=512)
    for doc, ids in docs:
        w.add(doc, ids.astype("<u4").tobytes())
    w.close()
    reader = B.PlaneReader(sink, sink.tell())
    start = 0
    for (doc, ids), (d, s, n, parts) in zip(docs, reader.documents(), strict=True):
        assert (d, s, n) == (doc, start, len(ids))
        assert (np.concatenate([*parts, np.zeros(0, "<u4")]) == ids).all()
        start += n
    flat = np.concatenate([i for _, i in docs])
    assert (reader.block(3) == flat[3 * 512 : 4 * 512]).all()  # any block alone


def test_files_of_odd_rows(spark):
    whole = library("word_bpe_49k.json")
    got = B.read_token_files(B.write_token_files(odd_docs(spark))).collect()
    assert len(got) == len(odd_rows())
    got.sort(key=lambda r: r.start)
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert ids == sorted(ids)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    crc = lambda t: zlib.crc32(np.array(whole(t) + [1], "<u4").tobytes())
    want = sorted(((r[0] is not None, r[0] or 0, crc(r[1])) for r in odd_rows()))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    assert B.read_token_files(B.write_token_files(no_docs(spark))).count() == 0


def test_differencing_partitions():
    r = random.Random(2)
    sizes = [r.randint(1, 500) for _ in range(300)]
    groups = K.differencing(sizes, 20)
    assert sorted(i for g in groups for i in g) == list(range(300))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 30
    assert len(K.windows([600] * 7, 1024)) == 7  # the count rises until all fit


def check_pieces(pieces, docs, whole, length=1024):
    by_doc: dict = {}
    by_seq: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += len(p.ids) // 4
        assert at <= length
    for doc, text in docs:
        own = sorted(by_doc[doc], key=lambda p: p.start)
        ids = b"".join(p.ids for p in own)
        assert ids == np.array(whole(text) + [0], "<u4").tobytes()
        assert [p.start for p in own] == [sum(len(x.ids) // 4 for x in own[:k]) for k in range(len(own))]
        assert {p.doc_tokens for p in own} == {len(ids) // 4}
    return sum(p.doc_tokens and len(p.ids) // 4 for p in pieces), len(by_seq)


def test_packing_real_documents(spark):
    whole = library("byte_bpe_50k.json")
    rows = [(r["doc_id"], r["text"]) for r in real_docs()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    total, sequences = check_pieces(K.pack_documents(docs).collect(), rows, whole)
    assert total > 0.97 * 1024 * sequences


def test_packing_odd_rows(spark):
    whole = library("byte_bpe_50k.json")
    once = [r for r in odd_rows() if r[0] not in (3, 9, None)]
    pieces = K.pack_documents(odd_docs(spark)).collect()
    check_pieces(pieces, [], whole)
    own = [(r[0], r[1]) for r in once]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    check_pieces(K.pack_documents(docs).collect(), own, whole)
    digest = K.packed_digest(K.pack_documents(docs)).collect()
    assert all(r.length > 0 and r.ids_crc32 >= 0 for r in digest)
    assert sum(len(p.ids) // 4 for p in pieces) == sum(len(whole(r[1])) + 1 for r in odd_rows())
    assert K.pack_documents(no_docs(spark)).count() == 0


def test_files_roll_and_hot_ids_are_cut(spark):
    hot = [(7, f"word{k % 50} here") for k in range(3000)]
    rows = hot + [(k, f"text {k}") for k in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    manifest = B.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), file_ids=500)
    files = manifest.collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(f.tokens for f in files) < 520 and sum(f.docs for f in files) == len(rows)
    by_part: dict = {}
    for f in files:
        by_part[f.part] = by_part.get(f.part, 0) + f.docs
    assert max(by_part.values()) < len(rows) / 4
    got = B.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
