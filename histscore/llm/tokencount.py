"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into the vocabulary's pre-tokens. The bytes of a pre-token are a
doubly linked list; a heap holds its adjacent pairs by merge rank, ties by
place. The lowest pair is popped, merged and unlinked, and the pairs it forms
with its neighbours are pushed; entries that no longer describe the list are
passed over. The count is the initial symbols minus the merges; no token ids
are made. The cost is n log n, also for a pre-token of a million bytes.

The pattern of the byte-level vocabularies is applied with numpy to many
texts at once, on the character classes (letter, number, white space, other),
and every distinct pre-token is merged once; counts are remembered per worker
up to a bound of bytes. Strings of the vocabulary's added tokens inside a text
are one token each and cut it, as the library does by default.

Defined cases: null and empty texts have 0 bytes and 0 tokens; ids may be null
or repeated, every row keeps its own count; a text of any length is counted
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histscore.llm.runs import array_of, distinct, pieces, text_bytes
from histscore.llm.tokens import tokenizer_path

LIMIT = 512
#: Bytes of remembered pre-tokens per worker, and the longest remembered.
KEPT, LONGEST = 24 << 20, 64
SPACE, LETTER, NUMBER, OTHER = range(4)
class Classes:
    """The classes of code points as the library's own pre-tokenizer tells
    them (its Unicode tables are its own), asked once per code point met."""

    UNKNOWN = 255

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.kind = np.full(0x110000, self.UNKNOWN, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        kind = self.kind[points]
        new = np.unique(points[kind == self.UNKNOWN]).tolist()
        for lo in range(0, len(new), 4096):
            self._ask(new[lo : lo + 4096])
        return self.kind[points] if new else kind

    def _ask(self, points: list[int]) -> None:
        # A letter stays with the "a" before it, a number with the "1" after
        # it, any other but a blank with the "!" after that.
        starts = {at for _, (at, _) in self.cut("".join(f"a{chr(c)}1{chr(c)}!" for c in points))}
        for k, c in enumerate(points):
            letter, number, other = (5 * k + j not in starts for j in (1, 2, 4))
            self.kind[c] = SPACE if c == 32 else LETTER if letter else NUMBER if number else OTHER if other else SPACE


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    itself if printable and not blank, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def pretoken_starts(points: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """True where a pre-token of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` starts; ``kind`` are the classes,
    ``heads`` the first places of the texts, which are cut alone."""
    n = len(points)
    space = kind == SPACE
    first = np.zeros(n + 1, bool)
    first[heads] = True
    first = first[:n]
    turn = first.copy()
    turn[1:] |= kind[1:] != kind[:-1]
    # The last blank of a run before a word: a space joins the word, any
    # other blank stands alone.
    opens = turn & ~space & ~first
    before = np.flatnonzero(opens) - 1
    before = before[space[before]]
    starts = turn
    starts[before] = True
    joins = points[before] == 32
    starts[before[joins] + 1] = False
    # An apostrophe that opens a pre-token takes its ending from the letters.
    quote = np.flatnonzero((points == 39) & starts)
    if len(quote):
        text = np.concatenate([points, np.zeros(2, points.dtype)])
        ended = np.concatenate([first, [True, True]])
        one, two = text[quote + 1], text[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"]) & ~ended[quote + 1]
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        pair &= ~single & ~ended[quote + 1] & ~ended[quote + 2]
        for at, size in ((quote[single], 2), (quote[pair], 3)):
            starts[at + 1] = False
            after = at + size
            after = after[after < n]
            starts[after] = True
    return starts


class Merger:
    """Counts of the tokens of byte strings under a list of merges."""

    def __init__(self, merges: list[tuple[str, str]]):
        number = {s: k for k, s in enumerate(byte_symbols())}
        for left, right in merges:
            number.setdefault(left + right, len(number))
        #: (left, right) as one integer -> (rank, merged symbol) as one.
        self.pairs = {}
        for rank, (left, right) in enumerate(merges):
            self.pairs[number[left] << 32 | number[right]] = rank << 32 | number[left + right]
        self.kept: dict[bytes, int] = {}
        self.size = 0

    def merged(self, word: bytes) -> int:
        """Initial symbols minus merges."""
        n = count = len(word)
        if n < 2:
            return n
        pairs = self.pairs
        symbol = list(word)
        heap = []
        for i in range(n - 1):
            to = pairs.get(symbol[i] << 32 | symbol[i + 1])
            if to is not None:
                heap.append((to >> 32, i, to))
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            _, i, to = heappop(heap)
            left = symbol[i]
            j = after[i]
            if left < 0 or j >= n or pairs.get(left << 32 | symbol[j]) != to:
                continue  # one side was merged meanwhile
            count -= 1
            symbol[i] = to & 0xFFFFFFFF
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pairs.get(symbol[i] << 32 | symbol[k])
                if new is not None:
                    heappush(heap, (new >> 32, i, new))
            h = before[i]
            if h >= 0:
                new = pairs.get(symbol[h] << 32 | symbol[i])
                if new is not None:
                    heappush(heap, (new >> 32, h, new))
        return count

    def counts(self, words: list[bytes]) -> np.ndarray:
        kept = self.kept
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            n = kept.get(w)
            if n is None:
                n = self.merged(w)
                if len(w) <= LONGEST:
                    kept[w] = n
                    self.size += len(w) + 80
            out[k] = n
        if self.size > KEPT:
            self.kept, self.size = {}, 0
        return out


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cut = told["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        model, added = told["model"], told["added_tokens"]
        plain = plain and told["normalizer"] is None and model["type"] == "BPE" and not model.get("ignore_merges")
        if not plain or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("a byte-level BPE vocabulary without normalisation is needed")
        self.merger = Merger([tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.classes = Classes()
        self.added = sorted((a["content"] for a in added), key=len, reverse=True)
        self.at_added = re.compile("|".join(map(re.escape, self.added))) if self.added else None

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a string column."""
        raw, at = text_bytes(column)
        n = len(column)
        out = np.zeros(n, np.int64)
        whole = raw.tobytes()
        heads, doc = at[:-1], np.arange(n)
        if any(a.encode() in whole for a in self.added):
            parts, heads, doc = self._without_added(column.to_pylist(), out)
            raw = np.frombuffer(b"".join(parts), np.uint8)
            whole = raw.tobytes()
        if not len(raw):
            return out
        lead = (raw & 0xC0) != 0x80
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero(lead)  # byte of every code point
        starts = pretoken_starts(points, self.classes.of(points), np.searchsorted(place, heads))
        offsets = np.append(place[starts], len(raw))
        codes, words = distinct(array_of(raw, offsets))
        owner = doc[np.searchsorted(heads, offsets[:-1], side="right") - 1]
        found = self.merger.counts(words)[codes]
        return out + np.bincount(owner, weights=found, minlength=n).astype(np.int64)

    def _without_added(self, texts: list[str | None], out: np.ndarray):
        """The parts of the texts between added tokens, their places in the
        joined parts and their texts; each added token counts one."""
        parts, heads, doc, at = [], [], [], 0
        for k, text in enumerate(texts):
            some = self.at_added.split(text or "")
            out[k] += len(some) - 1
            for part in some:
                heads.append(at)
                doc.append(k)
                parts.append(part.encode())
                at += len(parts[-1])
        return parts, np.array(heads, np.int64), np.array(doc, np.int64)


def counter(path: str) -> Counter:
    """The process's counter: a worker keeps what it counted between tasks."""
    kept = sys.modules.setdefault("_kept_counters", types.ModuleType("_kept_counters")).__dict__
    if path not in kept:
        kept[path] = Counter(path)
    return kept[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for part in pieces(batches, "text"):
            _, at = text_bytes(part.column(1))
            tokens = count(part.column(1))
            columns = [part.column(0), pa.array(np.diff(at)), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
