"""Packing by Karmarkar-Karp multiway differencing.

A document's ids (and the end id) are cut into full windows, which need no
packing, and a rest. Rests gather in a pool; a pool is packed into windows by
differencing: every piece starts as a partial partition with one loaded
window, and the two partial partitions of largest spread are merged, the
fullest windows of one with the emptiest of the other, until one partition is
left. If a window then exceeds the capacity, the window count rises by one
and the pool is packed again. The last ``FINE`` ids of a pool are cut finely:
small pieces even out what the large ones leave.

A pool never leaves its task, so nothing is shuffled and memory is bounded by
one pool; a task's last pool is smaller. Sequence ids carry the partition
number, and a partition holds the same rows when a lost task runs again.

Defined cases: null and empty texts have only the end id; ids may be null or
repeated (pieces of equal rows are packed separately); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histscore.llm.common import slices, whole_texts
from histscore.llm.tokens import encoder, tokenizer_path

LENGTH, END = 1024, 0
#: Windows of a pool, the longest piece of a rest, ids cut finely, their cuts.
POOL, PIECE, FINE = 32, 512, 2000
CUTS = (32, 24, 16, 12, 8, 6, 4, 3, 2, 1, 1)


def differencing(sizes: list[int], k: int) -> list[tuple[int, ...]]:
    """``k`` groups of item numbers with near-equal sums."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [()] * (k - 1) + [(i,)]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, s1, g1 = heapq.heappop(heap)
        _, _, s2, g2 = heapq.heappop(heap)
        sums = s1 + s2[::-1]  # ascending against descending
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        groups = [a + b for a, b in zip(g1, reversed(g2))]
        heapq.heappush(heap, (-int(sums[-1]), count, sums, [groups[j] for j in order.tolist()]))
        count += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], length: int) -> list[tuple[int, ...]]:
    """Near-equal windows of at most ``length``; their number rises until all
    fit. No item exceeds ``length``, so as many windows as items always do."""
    k = max(1, -(-sum(sizes) // length))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= length for g in groups):
            return [g for g in groups if g]
        k += 1


def cut_rest(size: int, fine: bool, piece: int = PIECE) -> list[int]:
    if not fine:
        n = -(-size // piece)
        return [size // n + (j < size % n) for j in range(n)]
    out, c = [], 0
    while size:
        out.append(min(size, CUTS[c % len(CUTS)]))
        size -= out[-1]
        c += 1
    return out


class Packer:
    """Packs a stream of documents; rows are (doc, start, ids, doc_tokens,
    sequence, offset)."""

    def __init__(self, first_sequence: int, length: int = LENGTH, pool: int = POOL):
        self.length, self.room = length, pool * (length - 1)
        self.next = first_sequence
        self.pool, self.total = [], 0
        self.piece = min(PIECE, length)
        self.fine = min(FINE, self.room // 4)

    def add(self, doc, ids: bytes):
        n = len(ids) // 4
        full = n // self.length * self.length
        for start in range(0, full, self.length):
            yield doc, start, ids[4 * start : 4 * (start + self.length)], n, self.next, 0
            self.next += 1
        at = full
        while at < n:
            fine = self.total >= self.room - self.fine
            limit = (self.room if fine else self.room - self.fine) - self.total
            for size in cut_rest(min(n - at, limit), fine, self.piece):
                self.pool.append((doc, at, ids[4 * at : 4 * (at + size)], n))
                self.total += size
                at += size
            if self.total >= self.room:
                yield from self.close()

    def close(self):
        sizes = [len(p[2]) // 4 for p in self.pool]
        for group in windows(sizes, self.length) if sizes else []:
            offset = 0
            for i in group:
                doc, start, ids, n = self.pool[i]
                yield doc, start, ids, n, self.next, offset
                offset += sizes[i]
            self.next += 1
        self.pool, self.total = [], 0


SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, path: str | None = None, cut: str = "spaced", end_id: int = END, length: int = LENGTH, pool: int = POOL
) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian 32-bit),
    doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    end = np.array([end_id], dtype="<u4").tobytes()
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        ids_of = encoder(path, cut).encode
        packer = Packer(TaskContext.get().partitionId() << 33, length, pool)
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        rows, held = [], 0
        for _, (ids, texts) in slices(batches, "doc_id", "text"):
            for doc, got in zip(ids, ids_of(texts)):
                for row in packer.add(doc, got + end):
                    rows.append(row)
                    held += len(row[2])
                if held > 4 << 20:
                    yield as_batch(rows)
                    rows, held = [], 0
        rows.extend(packer.close())
        if rows:
            yield as_batch(rows)

    return whole_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def packed_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with length and crc32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
