"""Quality rules: gradient-boosted trees over document statistics.

``document_stats`` measures whole texts. ``fit`` grows histogram trees on the
logistic loss from a bounded sample of labelled rows; a feature marked -1 may
only lower the score as it rises. ``Trees`` holds all trees as flat node
arrays, so a block of rows is scored by a few vectorised steps per level.

Base rules come first: fewer than ``MIN_WORDS`` words, or more than half of
the words inside 3-word windows that the text repeats, fails a document.

Defined cases: null and empty texts have no words and fail the base rule;
null ids are kept as they are; labels with null quality are left out; a
sample without both classes gives the verdict "keep" to all; repeated rows
are scored alike; an empty table gives an empty result; other columns are
carried by ``keep_documents`` and ignored by ``score_documents``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histscore.llm.common import BLANKS, slices, whole_texts

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Bound of the labelled sample: the rows of smallest id hash.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the sign a rise may have on the score (0: either).
FEATURES = (
    ("log_words", 0),
    ("mean_word", 0),
    ("symbol_rate", -1),
    ("bang_rate", -1),
    ("dup_line_rate", -1),
    ("repeat_rate", -1),
    ("upper_rate", -1),
    ("digit_rate", -1),
    ("unique_rate", 0),
    ("top_word_rate", 0),
    ("words_per_line", 0),
)
_BLANK_BYTES = BLANKS.encode()
_MARKS, _BANGS, _UPPER, _DIGIT = SYMBOLS.encode(), b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    hit = np.zeros(n + 2, dtype=bool)
    at = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    for k in range(3):
        hit[k : k + n] |= at
    return int(hit.sum())


def document_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The contract's counts and the trees' features of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # at the six ASCII blanks
    n = len(words)
    held = lambda marks: len(raw) - len(raw.translate(None, marks))
    chars = len(text) - held(_BLANK_BYTES)
    symbols, upper, digits = held(_MARKS), held(_UPPER), held(_DIGIT)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    counts = Counter(words)
    w, c = max(n, 1), max(chars, 1)
    features = [
        float(np.log1p(n)),
        chars / w,
        symbols / c,
        held(_BANGS) / c,
        dup / max(len(lines), 1),
        repeat / w,
        upper / c,
        digits / c,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        n / max(len(lines), 1),
    ]
    return [n, chars, symbols, dup, repeat], features


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def keep_all() -> Trees:
    one = np.zeros(1)
    i = np.zeros(1, dtype=np.int64)
    return Trees(i, one, i, i, one, i, 0, 30.0)


def fit(
    x: np.ndarray, y: np.ndarray, signs, trees: int = 60, depth: int = 4, rate: float = 0.15,
    bins: int = 64, l2: float = 1.0, min_rows: int = 10,
) -> Trees:
    """Boosting with binned splits. A split on a signed feature must order
    its two leaf values by the sign, and both subtrees stay on their side of
    the midpoint, so the whole model is monotonic in that feature."""
    if len(y) == 0 or y.min() == y.max():
        return keep_all()
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(value)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(v)
        return k

    def best_split(rows, g, h, lo, hi):
        top, tg, th = None, g[rows].sum(), h[rows].sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b, k = binned[rows, j], len(c) + 1
            gl = np.cumsum(np.bincount(b, g[rows], k))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], k))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=k))[:-1]
            wl = np.clip(-gl / (hl + l2), lo, hi)
            wr = np.clip(-(tg - gl) / (th - hl + l2), lo, hi)
            gain = -(gl * wl + 0.5 * (hl + l2) * wl**2) - ((tg - gl) * wr + 0.5 * (th - hl + l2) * wr**2)
            ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
            if signs[j]:
                ok &= signs[j] * (wr - wl) >= 0
            if ok.any():
                s = int(np.argmax(np.where(ok, gain, -np.inf)))
                if top is None or gain[s] > top[0]:
                    top = (gain[s], j, s, float(wl[s]), float(wr[s]))
        return top

    def grow(rows, g, h, level, lo, hi) -> int:
        w = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), lo, hi))
        k = node(rate * w)
        own = -(g[rows].sum() * w + 0.5 * (h[rows].sum() + l2) * w * w)
        split = best_split(rows, g, h, lo, hi) if level < depth and len(rows) >= 2 * min_rows else None
        if split is None or split[0] <= own + 1e-9:
            margin[rows] += rate * w
            return k
        _, j, s, wl, wr = split
        low = binned[rows, j] <= s
        mid = (wl + wr) / 2
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[signs[j]]
        feature[k], threshold[k] = j, float(cuts[j][s])
        left[k] = grow(rows[low], g, h, level + 1, *bounds[0])
        right[k] = grow(rows[~low], g, h, level + 1, *bounds[1])
        return k

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -8.0, 8.0))
    array = lambda a, t: np.asarray(a, dtype=t)
    return Trees(
        array(feature, np.int64), array(threshold, float), array(left, np.int64), array(right, np.int64),
        array(value, float), array(roots, np.int64), depth, base,
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """(features, quality) of at most ``rows`` labelled documents: the labelled
    ids of smallest hash, then their rows of smallest hash of id and text. An
    id with several labels takes the smallest; ids and rows are both bounded
    by ``rows``, whatever ids repeat."""
    ids = (
        labels.filter("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").alias("__label_id"))
        .agg(F.min("quality").cast("double").alias("__quality"))
        .orderBy(F.xxhash64("__label_id"), "__label_id")
        .limit(rows)
    )
    wanted = whole_texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("__label_id"))
    wanted = wanted.select("doc_id", "text", "__quality", F.xxhash64("doc_id", "text").alias("__hash"))

    def measure(batches):
        for part, (texts, quality) in slices(batches, "text", "__quality"):
            x = [document_stats(t)[1] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(x, pa.list_(pa.float64())), pa.array(quality, pa.float64()), part.column(3)],
                names=["doc_id", "x", "y", "h"],
            )

    measured = wanted.mapInArrow(measure, "doc_id long, x array<double>, y double, h long")
    got = measured.orderBy("h", "doc_id", "x").limit(rows).toPandas()
    got = got.sort_values(["doc_id", "y"], kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return x, got["y"].to_numpy(dtype=float)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **params) -> Trees:
    x, y = labelled_sample(docs, labels, rows)
    return fit(x, y, [s for _, s in FEATURES], **params)


def _measured(part, texts, trees: Trees, threshold: float):
    got = [document_stats(t) for t in texts]
    counts = np.array([c for c, _ in got], dtype=np.int64).reshape(len(got), len(STATS))
    score = trees.score(np.array([f for _, f in got], dtype=float).reshape(len(got), len(FEATURES)))
    words, repeat = counts[:, 0], counts[:, 4]
    failed = (words < MIN_WORDS) | (100 * repeat > 50 * words)
    return counts, failed, ~failed & (score >= threshold), score


def score_documents(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, score: one map-only pass."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for part, (texts,) in slices(batches, "text"):
            counts, failed, kept, score = _measured(part, texts, shared.value, threshold)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(counts[:, k]) for k in range(len(STATS))], pa.array(failed), pa.array(kept), pa.array(score)],
                names=["doc_id", *STATS, "base_failed", "kept", "score"],
            )

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, kept boolean, score double"
    return whole_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep_documents(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that pass, with all their columns: one map-only pass."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for part, (texts,) in slices(batches, "text"):
            yield part.filter(pa.array(_measured(part, texts, shared.value, threshold)[2]))

    return whole_texts(docs).mapInArrow(run, docs.schema)
