"""Source divergence audit by single-pass in-memory indexing.

1. *Index.* A task reads its documents once and collects block postings:
   (term, group) -> occurrences and documents, a group being (lang, source).
   When the block fills its memory it is spilled as a term-sorted run, in
   chunks per hash shard, to the shared folder.
2. *Merge.* The chunks of a shard come sorted by their first term, and a heap
   of open chunks merges them: a chunk is opened only when the heap's least
   term reaches its first. ``FAN`` tasks' runs are merged at a time, in as
   many levels as it takes, so a merge holds a bounded number of chunks. The
   last level knows every term's documents per lang and keeps those with
   enough: the frequency table, one row per lang and kept term.
3. *Corrections.* A term in neither of two sources adds the same difference
   of their floors, so a pair starts with V times that, and the frequencies
   are streamed once for the corrections: a term adds to the pairs of the
   sources that have it only. A task sums them in rows of a matrix of bounded
   size; Spark sums the tasks.

All arithmetic is on integers.

Defined cases: null text, lang and source count as empty; an empty string is
a lang or source like others; repeated rows count again; groups without terms
stay, with all floors; without kept terms all pair values are 0; texts and
terms of any length are taken whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histscore.llm.common import open_store, out_dir
from histscore.llm.runs import distinct, lower_ascii, pieces, split_runs, text_bytes

#: Documents a kept term needs, added occurrences, scale, terms reported.
DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of a block, hash shards, postings of a chunk, tasks merged at once.
BLOCK, SHARDS, CHUNK, FAN = 64 << 20, 256, 1024, 64
#: A block's documents stand above its occurrences in one integer.
SHIFT, MOST_ROWS = 42, 1 << 20
#: Bytes of corrections a task holds.
HELD = 32 << 20

RUNS = "part long, shard int, first binary, langs array<string>, sources array<string>, terms binary, groups binary, counts binary, docs binary"


class Block:
    """Postings in memory: group -> term -> documents and occurrences."""

    def __init__(self):
        self.groups: dict[tuple[str, str], dict[bytes, int]] = {}
        self.size = self.rows = 0

    def add(self, part: pa.RecordBatch) -> None:
        raw, at = text_bytes(part.column(2))
        raw = lower_ascii(raw)
        doc, terms = split_runs(raw, at, ((raw >= 97) & (raw <= 122)) | (raw >= 128))
        names = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
        self.rows += len(names)
        for name in names:
            held = self.groups.setdefault(name, {})
            held[b""] = held.get(b"", 0) + (1 << SHIFT)  # the empty term counts the group's documents
        codes, found = distinct(terms)
        if not found:
            return
        number = {name: k for k, name in enumerate(dict.fromkeys(names))}
        group = np.array([number[n] for n in names], np.int64)
        pairs, times = np.unique(doc * len(found) + codes, return_counts=True)
        doc, code = np.divmod(pairs, len(found))
        keys, place = np.unique(group[doc] * len(found) + code, return_inverse=True)
        packed = np.bincount(place, times).astype(np.int64) + (np.bincount(place) << SHIFT)
        of, code = np.divmod(keys, len(found))
        cuts = np.searchsorted(of, np.arange(len(number) + 1))
        for name, lo, hi in zip(number, cuts[:-1].tolist(), cuts[1:].tolist()):
            held = self.groups[name]
            for k, n in zip(code[lo:hi].tolist(), packed[lo:hi].tolist()):
                term = found[k]
                if term in held:
                    held[term] += n
                else:
                    held[term] = n
                    self.size += len(term) + 150

    def full(self, room: int) -> bool:
        return self.size > room or self.rows >= MOST_ROWS

    def run(self, part: int, shards: int, chunk: int) -> Iterator[pa.RecordBatch]:
        """The block as a run sorted by shard, term and group."""
        names = list(self.groups)
        terms = [t for held in self.groups.values() for t in held]
        group = np.repeat(np.arange(len(names)), [len(h) for h in self.groups.values()])
        packed = np.array([n for held in self.groups.values() for n in held.values()], np.int64)
        shard = np.array([crc32(t) % shards for t in terms])
        table = pa.table({"shard": shard, "term": pa.array(terms, pa.binary()), "group": group})
        order = pc.sort_indices(table, [(c, "ascending") for c in table.column_names]).to_numpy()
        terms = [terms[k] for k in order.tolist()]
        group, packed, shard = group[order], packed[order], shard[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1)).tolist()
        rows = []
        for s in range(shards):
            for lo in range(cuts[s], cuts[s + 1], chunk):
                hi = min(lo + chunk, cuts[s + 1])
                used, local = np.unique(group[lo:hi], return_inverse=True)
                counts, docs = packed[lo:hi] & ((1 << SHIFT) - 1), packed[lo:hi] >> SHIFT
                rows.append(chunk_row(part, s, [names[k] for k in used], terms[lo:hi], local, counts, docs))
            if len(rows) >= 64:
                yield as_runs(rows)
                rows = []
        if rows:
            yield as_runs(rows)


def chunk_row(part, shard, names, terms, group, counts, docs) -> tuple:
    """Terms hold no zero byte, so zero bytes part them."""
    langs, sources = zip(*names)
    packed = [np.asarray(group, "<i4").tobytes(), np.asarray(counts, "<i8").tobytes(), np.asarray(docs, "<i8").tobytes()]
    return (part, shard, terms[0], list(langs), list(sources), b"\0".join(terms), *packed)


RUN_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 4]
RUN_NAMES = [c.split()[0] for c in RUNS.split(", ")]


def as_runs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RUN_TYPES)], names=RUN_NAMES)


class Cursor:
    """An open chunk."""

    def __init__(self, row: dict):
        names = list(zip(row["langs"], row["sources"]))
        self.terms = row["terms"].split(b"\0")
        self.names = [names[k] for k in np.frombuffer(row["groups"], "<i4").tolist()]
        self.counts = np.frombuffer(row["counts"], "<i8").tolist()
        self.docs = np.frombuffer(row["docs"], "<i8").tolist()
        self.at = 0

    def take(self, term: bytes, into: dict) -> bytes | None:
        """Adds the term's postings to ``into``; the next term, if any."""
        k, terms = self.at, self.terms
        while k < len(terms) and terms[k] == term:
            have = into.get(self.names[k])
            if have is None:
                into[self.names[k]] = [self.counts[k], self.docs[k]]
            else:
                have[0] += self.counts[k]
                have[1] += self.docs[k]
            k += 1
        self.at = k
        return terms[k] if k < len(terms) else None


def merged(chunks: Iterator[dict]) -> Iterator[tuple[bytes, dict]]:
    """(term, group -> [occurrences, documents]) in term order, of chunks
    sorted by their first term."""
    heap: list = []
    opened = 0
    chunk = next(chunks, None)
    while heap or chunk:
        while chunk and (not heap or chunk["first"] <= heap[0][0]):
            heappush(heap, (chunk["first"], opened, Cursor(chunk)))
            opened += 1
            chunk = next(chunks, None)
        term, total = heap[0][0], {}
        while heap and heap[0][0] == term:
            _, order, cursor = heap[0]
            ahead = cursor.take(term, total)
            if ahead is None:
                heappop(heap)
            else:
                heapreplace(heap, (ahead, order, cursor))
        yield term, total


def _chunk_rows(batches) -> Iterator[dict]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 16):
            yield from batch.slice(lo, 16).to_pylist()


def write_runs(docs: DataFrame, path: str, block: int, shards: int, chunk: int) -> DataFrame:
    def run(batches):
        part, held = TaskContext.get().partitionId(), Block()
        for piece in pieces(batches, "text"):
            held.add(piece)
            if held.full(block):
                yield from held.run(part, shards, chunk)
                held = Block()
        if held.groups:
            yield from held.run(part, shards, chunk)

    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs.select(*empty).mapInArrow(run, RUNS).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _by_shard(runs: DataFrame, fan: int) -> DataFrame:
    placed = runs.withColumn("part", F.floor(F.col("part") / fan).cast("long"))
    return placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "first")


def merge_level(runs: DataFrame, fan: int, chunk: int, path: str) -> DataFrame:
    """The runs of ``fan`` tasks merged to one."""

    def run(batches):
        for (shard, part), chunks in groupby(_chunk_rows(batches), key=lambda r: (r["shard"], r["part"])):
            terms, names, counts, docs = [], [], [], []
            for term, total in merged(iter(chunks)):
                for name, (n, d) in sorted(total.items()):
                    terms.append(term)
                    names.append(name)
                    counts.append(n)
                    docs.append(d)
                if len(terms) >= chunk:
                    yield as_runs([_packed(part, shard, names, terms, counts, docs)])
                    terms, names, counts, docs = [], [], [], []
            if terms:
                yield as_runs([_packed(part, shard, names, terms, counts, docs)])

    _by_shard(runs, fan).mapInArrow(run, RUNS).write.parquet(path)
    return runs.sparkSession.read.parquet(path)


def _packed(part, shard, names, terms, counts, docs) -> tuple:
    number = {name: k for k, name in enumerate(dict.fromkeys(names))}
    return chunk_row(part, shard, list(number), terms, [number[n] for n in names], counts, docs)


FREQUENCIES = "lang string, term string, sources array<string>, counts array<long>"


def term_frequencies(
    docs: DataFrame, least: int = DOCS, block: int = BLOCK, shards: int = SHARDS, chunk: int = CHUNK, fan: int = FAN
) -> DataFrame:
    """lang, term, and the occurrences by source of each term in at least
    ``least`` of the lang's documents; the empty term lists all sources."""
    path = out_dir(docs.sparkSession, "term-runs")
    runs = write_runs(docs, f"{path}/level-0", block, shards, chunk)
    parts, level = (runs.agg(F.max("part")).first()[0] or 0) + 1, 0
    while parts > fan:
        level += 1
        runs = merge_level(runs, fan, chunk, f"{path}/level-{level}")
        parts = -(-parts // fan)

    def run(batches):
        rows = []
        for _, chunks in groupby(_chunk_rows(batches), key=lambda r: r["shard"]):
            for term, total in merged(iter(chunks)):
                by_lang: dict = {}
                for (lang, source), (n, d) in sorted(total.items()):
                    by_lang.setdefault(lang, []).append((source, n, d))
                for lang, found in by_lang.items():
                    if not term or sum(d for _, _, d in found) >= least:
                        sources, counts, _ = zip(*found)
                        rows.append((lang, term.decode(), list(sources), list(counts)))
                if len(rows) >= 1000:
                    yield _frequencies(rows)
                    rows = []
        if rows:
            yield _frequencies(rows)

    _by_shard(runs, fan).mapInArrow(run, FREQUENCIES).write.parquet(f"{path}/frequencies")
    return docs.sparkSession.read.parquet(f"{path}/frequencies")


def _frequencies(rows) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lang", "term", "sources", "counts"])


def group_sizes(found: DataFrame, path: str) -> DataFrame:
    """lang, source, n (occurrences of kept terms), v (the lang's kept terms)."""
    each = found.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("p"))
    sizes = each.groupBy("lang", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("n"))
    kept = found.where("term <> ''").groupBy("lang").agg(F.count("*").alias("v"))
    sizes.join(kept, "lang", "left").select("lang", "source", "n", F.coalesce("v", F.lit(0)).alias("v")).write.parquet(path)
    return found.sparkSession.read.parquet(path)


class Lang:
    """A lang's sources, and the corrections of their pairs in rows of a
    matrix of bounded size."""

    def __init__(self, sources: list[str], sizes: list[int], v: int, room: int):
        self.sources, self.place = sources, {s: k for k, s in enumerate(sources)}
        self.over = np.array(sizes, np.int64) + ADDED * v
        self.total = int(sum(sizes)) + ADDED * v
        self.floor = shares(np.zeros(len(sources), np.int64), self.over)
        self.rows = np.zeros((max(1, min(len(sources), room // (8 * len(sources)))), len(sources)), np.int64)
        self.clear()

    def clear(self):
        self.rows[:] = 0
        self.slot = np.full(len(self.sources), -1, np.int64)
        self.used = 0

    def add(self, at: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Corrections of one term in the sources ``at`` with shares ``p``;
        what the matrix holds comes out when it is full."""
        for lo in range(0, len(at), len(self.rows)):
            some = slice(lo, lo + len(self.rows))
            new = at[some][self.slot[at[some]] < 0]
            if self.used + len(new) > len(self.rows):
                yield from self.flush()
                new = at[some]
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            floors = np.abs(self.floor[at[some], None] - self.floor)
            gain = np.abs(p[some, None] - self.floor) - floors
            both = np.abs(p[some, None] - p) - floors[:, at]
            gain[:, at] = np.where(at[some, None] < at, both, 0)  # said once
            self.rows[self.slot[at[some]]] += gain

    def flush(self) -> Iterator[tuple[int, int, int]]:
        for i in np.flatnonzero(self.slot >= 0).tolist():
            row = self.rows[self.slot[i]]
            for j in np.flatnonzero(row).tolist():
                yield min(i, j), max(i, j), int(row[j])
        self.clear()


def shares(counts: np.ndarray, over: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / over), exactly."""
    if len(counts) and counts.max() + ADDED > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (c + ADDED) // o if o else 0 for c, o in zip(counts.tolist(), over.tolist())], np.int64)
    return np.where(over > 0, 1 + SCALE * (counts + ADDED) // np.maximum(over, 1), 0)


PARTIALS = "lang string, source string, part string, item string, value long"


def corrections(found: DataFrame, groups: str, room: int) -> DataFrame:
    """Partial sums of pair corrections, and each term's gains."""

    def run(batches):
        store, base = open_store(groups)
        told = pq.read_table(base, filesystem=store).to_pandas().sort_values(["lang", "source"])
        by_lang = {lang: g for lang, g in told.groupby("lang")}
        langs: dict[str, Lang] = {}
        rows = []
        for batch in batches:
            for row in batch.to_pylist():
                name, term = row["lang"], row["term"]
                if name not in langs:
                    g = by_lang[name]
                    langs[name] = Lang(g["source"].tolist(), g["n"].tolist(), int(g["v"].iloc[0]), max(1, room // len(by_lang)))
                lang = langs[name]
                at = np.array([lang.place[s] for s in row["sources"]])
                counts = np.array(row["counts"], np.int64)
                p = shares(counts, lang.over[at])
                q = 1 + SCALE * (sum(row["counts"]) + ADDED) // lang.total
                for k in np.flatnonzero((p > q) & (counts > 0)).tolist():
                    rows.append((name, row["sources"][k], "term", term, int(p[k]) - q))
                for i, j, value in lang.add(at, p):
                    rows.append((name, lang.sources[i], "pair", lang.sources[j], value))
                if len(rows) >= 20_000:
                    yield _partials(rows)
                    rows = []
        for name, lang in langs.items():
            for i, j, value in lang.flush():
                rows.append((name, lang.sources[i], "pair", lang.sources[j], value))
                if len(rows) >= 20_000:
                    yield _partials(rows)
                    rows = []
        if rows:
            yield _partials(rows)

    return found.where("term <> ''").mapInArrow(run, PARTIALS)


def _partials(rows) -> pa.RecordBatch:
    types = [*[pa.string()] * 4, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lang", "source", "part", "item", "value"])


def audit_sources(
    docs: DataFrame, least: int = DOCS, top: int = TOP, block: int = BLOCK, shards: int = SHARDS, chunk: int = CHUNK, fan: int = FAN, room: int = HELD
) -> DataFrame:
    """lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    path = out_dir(spark, "divergence")
    found = term_frequencies(docs, least, block, shards, chunk, fan)
    groups = group_sizes(found, f"{path}/groups")
    corrections(found, f"{path}/groups", room).write.partitionBy("part").parquet(f"{path}/partials")
    partial = spark.read.schema("lang string, source string, item string, value long, part string").parquet(f"{path}/partials")
    order = [F.col("value").desc(), F.col("item").asc()]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    terms = partial.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)

    once = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    over = F.col("n") + ADDED * F.col("v")
    floor = F.when(over > 0, 1 + F.call_function("div", F.lit(SCALE * ADDED).cast("long"), over)).otherwise(F.lit(0).cast("long"))
    floors = groups.select("lang", "source", "v", floor.alias("floor"))
    other = floors.select("lang", F.col("source").alias("item"), F.col("floor").alias("other"))
    pairs = (
        floors.join(other, "lang")
        .where(F.col("source") < F.col("item"))
        .join(once, ["lang", "source", "item"], "left")
        .select("lang", "source", "item", (F.col("v") * F.abs(F.col("floor") - F.col("other")) + F.coalesce("more", F.lit(0))).alias("value"))
    )
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", "w.item", "value").withColumn("rank", rank)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
