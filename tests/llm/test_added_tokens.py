"""Added tokens that stand in a text, against the library as it comes."""

import random
import zlib
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from histscore.llm import bitplanes as B
from histscore.llm import packing as K
from histscore.llm import tokens as T

PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "\n", "It's", "é", "日本", "Σ", "<"]
DOCS = [(1, "end <|endoftext|> next"), (2, "<|startoftext|>a <|endoftext|><|endoftext|>"), (3, "plain"), (4, None)]


@cache
def library(name):
    return Tokenizer.from_file(T.tokenizer_path(name))


def ids_bytes(name, text, end=()):
    return np.array([*library(name).encode(text or "", add_special_tokens=False).ids, *end], "<u4").tobytes()


@pytest.mark.parametrize("name, cut", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_added_tokens_in_texts(name, cut):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(1500)] + [t for _, t in DOCS]
    got = T.Encoder(T.tokenizer_path(name), cut).encode(texts)
    assert got == [ids_bytes(name, t) for t in texts]


def test_token_files_hold_added_tokens(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = sorted(B.read_token_files(B.write_token_files(docs)).collect())
    want = [ids_bytes("word_bpe_49k.json", t, [B.END]) for _, t in DOCS]
    assert [r.n_tokens for r in rows] == [len(w) // 4 for w in want]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(w) for w in want]
    assert [r.start for r in rows] == [sum(len(w) // 4 for w in want[:k]) for k in range(len(want))]


def test_packed_pieces_hold_added_tokens(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {}
    for p in sorted(K.pack_documents(docs).collect(), key=lambda p: (p.doc_id, p.start)):
        got[p.doc_id] = got.get(p.doc_id, b"") + p.ids
    assert got == {d: ids_bytes("byte_bpe_50k.json", t, [K.END]) for d, t in DOCS}
