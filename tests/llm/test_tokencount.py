"""Token counts against the library as it comes."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from histscore.llm import tokencount as C
from histscore.llm.tokens import tokenizer_path
from tests.llm.helpers import no_docs, odd_docs, odd_rows, real_docs

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = list("ab'sstmdrevl9 \n\t\x0b\r\x1c\x85\xa0 　́.!?ZÀßΣ\U0001f600​日本 ²Ⅷ") + [
    "<|endoftext|>", "<|endof", "'re", "'ll", "'ve", "  ", "don't", "\x00"
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return C.Counter(PATH)


def test_odd_texts(library, counter, monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(20_000)]
    texts += [None, "", "'", "'s", " 's", "\n's's'rest", "''s", "a" * 9000, " " * 999, "日本" * 700, "don't" * 50]
    want = library(texts)
    assert counter.count(pa.array(texts)).tolist() == want
    monkeypatch.setattr(C, "KEPT", 4000)  # forgets and merges again
    some = [counter.count(pa.array(texts[k : k + 61], pa.string())).tolist() for k in range(0, len(texts), 61)]
    assert [n for s in some for n in s] == want


def test_every_code_point(library, counter):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}b{c} 1{c}" for c in every[lo : lo + 500]) for lo in range(0, len(every), 500)]
    assert counter.count(pa.array(texts)).tolist() == library(texts)


def test_merges_in_rank_order():
    m = C.Merger([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a")])
    assert m.merged(b"abc") == 1
    assert m.merged(b"abbc") == 2
    assert m.merged(b"aaa") == 2
    assert m.merged(b"aabcaab") == 4
    assert m.merged(b"") == 0


def test_documents(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in real_docs()]
    got = C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(rows, library([t for _, t in rows]))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_and_empty_tables(spark, library):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = sorted(map(tuple, C.count_tokens(odd_docs(spark)).collect()), key=key)
    texts = [r[1] for r in odd_rows()]
    want = [(r[0], len((t or "").encode()), n, n > 512) for r, t, n in zip(odd_rows(), texts, library(texts))]
    assert got == sorted(want, key=key)
    assert C.count_tokens(no_docs(spark)).count() == 0
