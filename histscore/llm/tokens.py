"""Token ids of whole texts, encoding each distinct run once.

A text is cut where the tokenizer's own pre-tokenization always cuts, so the
ids of the parts, joined, are the ids of the whole text:

- ``words``: the pattern of vocabularies that lower-case and drop white
  space, on the lower-cased text. It holds for ASCII and the Latin-1 letters,
  which no normalisation changes but lower-casing; a part between ASCII blanks
  with any other character is encoded whole;
- ``spaced``: the byte-level pattern of vocabularies that keep it, on the
  library's own character classes.

Cutting, looking up and joining are done with numpy and Arrow on about
``TOGETHER`` bytes of text at a time. The library's model encodes new runs,
which need no more normalising or cutting; the whole library encodes the other
parts. Both are remembered per worker process up to ``KEPT`` bytes, then
learnt again.

Ids are little-endian unsigned 32-bit bytes; joining ids is joining bytes.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa

from histscore.llm.runs import array_of, distinct

#: Bytes of remembered runs per worker, the longest remembered, and bytes of
#: text cut and looked up together.
KEPT, LONGEST, TOGETHER = 64 << 20, 64, 1 << 20
#: A run of the pattern on plain text in lower case.
_WORD = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\[-`{-~]+").fullmatch
SPACE, LETTER, NUMBER, OTHER, FOREIGN = range(5)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, cut: str) -> Encoder:
    """The process's encoder: a worker keeps what it learnt between tasks."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    if (path, cut) not in kept:
        kept[path, cut] = Encoder(path, cut)
    return kept[path, cut]


def _plain_kinds() -> np.ndarray:
    """The classes of the code points up to U+00FF; all others are foreign."""
    kind = np.full(257, FOREIGN, np.uint8)
    kind[33:127] = OTHER
    kind[[*range(9, 14), 32]] = SPACE
    kind[48:58] = NUMBER
    kind[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
    return kind


class Encoder:
    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from histscore.llm.tokencount import Classes, byte_symbols, pretoken_starts

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(a.normalized or a.lstrip or a.rstrip or a.single_word for a in added):
            raise ValueError("added tokens must be matched as they stand")
        self.added = sorted((a.content for a in added), key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(map(re.escape, self.added))})").split
        self.cut, self.model = cut, self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.kind, self.classes, self.pretoken_starts = _plain_kinds(), Classes(), pretoken_starts
        self.learnt: dict[bytes, bytes] = {}
        self.size = 0

    # ------------------------------------------------------------- cutting
    def _spaced(self, points: np.ndarray, heads: np.ndarray, whole: np.ndarray):
        starts = self.pretoken_starts(points, self.classes.of(points), heads)
        starts &= ~whole
        return points, starts, np.ones(len(points), bool)

    def _words(self, points: np.ndarray, heads: np.ndarray, whole: np.ndarray):
        kind = self.kind[np.minimum(points, 256)]
        kind[whole] = FOREIGN
        first = np.zeros(len(points) + 1, bool)
        first[heads] = True
        first = first[:-1]
        space = kind == SPACE
        opens = first.copy()  # first place of a part between blanks, or of blanks
        opens[1:] |= space[1:] != space[:-1]
        part = np.cumsum(opens) - 1
        foreign = np.bincount(part[kind == FOREIGN], minlength=part[-1] + 1)[part] > 0
        starts = opens.copy()
        starts[1:] |= kind[1:] != kind[:-1]
        starts |= kind == NUMBER
        quote = np.flatnonzero((points == 39) & starts)
        text = np.concatenate([points | ((points >= 65) & (points <= 90)) * np.uint32(32), np.zeros(2, np.uint32)])
        ended = np.concatenate([opens, [True, True]])
        one, two = text[quote + 1], text[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"]) & ~ended[quote + 1]
        pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        pair &= ~single & ~ended[quote + 1] & ~ended[quote + 2]
        for at, size in ((quote[single], 2), (quote[pair], 3)):
            starts[at + 1] = False
            after = at + size
            starts[after[after < len(points)]] = True
        starts = np.where(foreign, opens, starts)
        upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
        points = points + (upper & ~foreign) * np.uint32(32)
        return points, starts, ~space

    def _runs(self, segments: list[tuple[str, bool]]) -> tuple[np.ndarray, pa.Array]:
        """The segment of each run, and the runs; a whole segment is one."""
        points = np.frombuffer("".join(s for s, _ in segments).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(s) for s, _ in segments], np.int64)
        if not len(points):
            return np.zeros(0, np.int64), array_of(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        heads = np.cumsum(sizes) - sizes
        whole = np.zeros(len(points), bool)
        for k, (s, alone) in enumerate(segments):
            if alone:
                whole[heads[k] + (self.cut == "spaced") : heads[k] + len(s)] = True
        points, starts, kept = (self._words if self.cut == "words" else self._spaced)(points, heads, whole)
        begin = np.flatnonzero(starts & kept)
        raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        place = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of every code point
        if not kept.all():
            width = np.diff(np.append(place, len(raw)))
            raw = raw[np.repeat(kept, width)]
            place = np.cumsum(width * kept) - width * kept
        return np.searchsorted(heads, begin, side="right") - 1, array_of(raw, np.append(place[begin], len(raw)))

    # ------------------------------------------------------------ encoding
    def _learn(self, runs: list[bytes]) -> None:
        tokenize, symbols, spaced = self.model.tokenize, self.symbols, self.cut == "spaced"
        odd = []
        for r in runs:
            text = r.decode()
            if text not in self.added if spaced else _WORD(text):
                ids = array("I", [t.id for t in tokenize(r.decode("latin-1").translate(symbols))])
                self._keep(r, ids)
            else:
                odd.append((r, text))
        for at in range(0, len(odd), 1024):
            some = odd[at : at + 1024]
            got = self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)
            for (r, _), g in zip(some, got):
                self._keep(r, array("I", g.ids))

    def _keep(self, run: bytes, ids: array) -> None:
        if sys.byteorder == "big":
            ids.byteswap()
        self.learnt[run] = ids.tobytes()
        self.size += len(run) + 4 * len(ids) + 170

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for null."""
        out, some, size = [], [], 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size >= TOGETHER:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        segments, owner = [], []
        for k, t in enumerate(texts):
            if any(a in t for a in self.added):
                parts = [(p, j % 2 == 1) for j, p in enumerate(self.at_added(t)) if p]
            else:
                parts = [(t, False)]
            segments += parts
            owner += [k] * len(parts)
        segment, runs = self._runs(segments)
        codes, found = distinct(runs)
        self._learn([r for r in found if r not in self.learnt])
        ids = pa.array(list(map(self.learnt.__getitem__, found)), pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = ids.buffers()[2].to_pybytes() if len(ids) and ids.buffers()[2] else b""
        cuts = ends[np.searchsorted(np.array(owner, np.int64)[segment], np.arange(len(texts) + 1))].tolist()
        for r in found:
            if len(r) > LONGEST:
                self.size -= len(r) + len(self.learnt.pop(r)) + 170
        if self.size > KEPT:
            self.learnt, self.size = {}, 0
        return [data[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]
