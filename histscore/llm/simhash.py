"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased, 4-word shingles (repeats included), XXH64 with
seed 42, a bit set if over half the shingles set it. Documents link when
their fingerprints differ in at most ``MAX_BITS`` bits; groups are the
connected components.

Finding links. Of ``MAX_BITS + 1`` bit blocks at least one agrees in any
linked pair, so each distinct fingerprint goes to one bucket per block. A
bucket is sorted by Gray rank and indexed: the leaves are fingerprints, each
upper node keeps the bits all below it share, and a child only the bits its
parent does not have. A search adds up differing bits from the top and drops
a whole node once they exceed the limit; it takes a whole node at once when
even its open bits cannot exceed it. A bucket emits a spanning star per
component it sees, never all its pairs.

Large buckets. Above ``BUCKET`` fingerprints a bucket is dealt again on the
remaining bits (one of ``MAX_BITS + 1`` sub-blocks agrees as well); what is
then still too large (a big cluster of near copies) is cut into chunks, and
every pair of chunks is searched by a task of its own. No candidate is lost
at any size, and no task holds more than two chunks.

The stars of all buckets are joined to components by alternating large-star
and small-star steps on fingerprints, checkpointed each round.

Defined cases: a text without words has fingerprint zero and links like any
other; a null id gets a fingerprint and is ignored for the smallest id (null
if the whole group has none); repeated ids are separate rows of a group;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histscore.llm.common import join_checked, slices, whole_texts
from histscore.session import checkpointed

SHINGLE, MAX_BITS, SEED = 4, 4, 42
BUCKET = 2048
#: Tasks a hot key of a join is spread over; a fingerprint is hot with more
#: rows than this share of all.
SALTS, HOT_SHARE = 8, 500
FANOUT = 16
#: Pairs of (query, node) looked at together.
FRONTIER = 1 << 21


# ------------------------------------------------------------ fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one whole text, unsigned."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z only
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(flat[a:b], SEED) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())]
    n, count = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        count += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * count > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): one map-only pass."""

    def run(batches):
        for part, (texts,) in slices(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return whole_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` and __fp."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])

    def run(batches):
        for part, (texts,) in slices(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], names=[*part.schema.names, "__fp"])

    return whole_texts(docs).mapInArrow(run, schema)


# ------------------------------------------------------- hierarchical index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the Gray code sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes of ``FANOUT`` children."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        n = len(fps)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        pattern, shared, first = fps, np.full(n, full), np.arange(n)
        levels = []
        while True:
            levels.append([pattern, shared, first])
            if len(pattern) == 1:
                break
            cut = np.arange(0, len(pattern), FANOUT)
            low = np.bitwise_and.reduceat(pattern, cut)
            high = np.bitwise_or.reduceat(pattern, cut)
            shared = np.bitwise_and.reduceat(shared, cut) & ~(low ^ high)
            pattern, first = low, first[cut]
        levels.reverse()
        self.levels = []
        for depth, (pattern, shared, first) in enumerate(levels):
            above = levels[depth - 1][1][np.arange(len(pattern)) // FANOUT] if depth else np.uint64(0)
            free = 64 - np.bitwise_count(shared).astype(np.int16)
            last = np.append(first[1:], n)
            self.levels.append((pattern, shared & ~above, free, first, last))

    def search(self, queries: np.ndarray, limit: int):
        """(query, member) pairs within ``limit`` bits, and (query, first,
        last) ranges taken whole; a pair may come both ways."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        acc = np.zeros(len(queries), dtype=np.int16)
        pairs, whole = (q[:0], q[:0]), []
        for depth, (pattern, bits, free, first, last) in enumerate(self.levels):
            acc = acc + np.bitwise_count((queries[q] ^ pattern[node]) & bits[node])
            near = acc <= limit
            q, node, acc = q[near], node[near], acc[near]
            if depth == len(self.levels) - 1:
                pairs = (q, node)
                break
            sure = acc + free[node] <= limit
            if sure.any():
                whole.append((q[sure], first[node[sure]], last[node[sure]]))
                q, node, acc = q[~sure], node[~sure], acc[~sure]
            below = len(self.levels[depth + 1][0])
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            real = child < below
            q, node, acc = np.repeat(q, FANOUT)[real], child[real], np.repeat(acc, FANOUT)[real]
        return pairs, whole


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i]; labels are roots afterwards."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def bucket_stars(index_fps: np.ndarray, query_fps: np.ndarray | None, limit: int):
    """(member, centre) of each component seen in a bucket: links inside
    ``index_fps``, or between it and ``query_fps``."""
    fps = index_fps[np.argsort(gray_rank(index_fps), kind="stable")]
    index = GrayIndex(fps)
    n = len(fps)
    queries, at = (fps, 0) if query_fps is None else (query_fps, n)
    every = fps if query_fps is None else np.concatenate([fps, query_fps])
    label = np.arange(len(every))
    step = max(1, FRONTIER // max(n, 1))
    for lo in range(0, len(queries), step):
        (q, member), whole = index.search(queries[lo : lo + step], limit)
        _hook(label, q + lo + at, member)
        for q, first, last in whole:
            _hook(label, q + lo + at, first)
            # members first..last-1 hang together through the query
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, last - 1, -1)
            tied = np.flatnonzero(np.cumsum(cover)[: n - 1] > 0)
            _hook(label, tied, tied + 1)
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


# ------------------------------------------------------------- Spark plan


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of ``parts`` blocks covering ``width`` bits."""
    cut = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def _bits(col, offset: int, width: int):
    return F.shiftrightunsigned(col, offset).bitwiseAND(F.lit((1 << width) - 1))


def _without(col, offset: int, width: int):
    """The word with a block of bits taken out."""
    low = col.bitwiseAND(F.lit((1 << offset) - 1))
    high = F.shiftrightunsigned(col, offset + width) if offset + width < 64 else F.lit(0).cast("long")
    return F.shiftleft(high, offset).bitwiseOR(low)


def _in_buckets(fps: DataFrame, limit: int, bucket: int) -> DataFrame:
    """b, v, b2, v2, i, j, side, fp: the tasks' groups. Side 0 is indexed,
    side 1 is searched in it; a group without side 1 is searched in itself."""
    blocks = _blocks(64, limit + 1)
    none = F.lit(-1).cast("long")
    first = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(b).alias("b"), _bits(F.col("fp"), o, w).alias("v"), _without(F.col("fp"), o, w).alias("rest"))
                      for b, (o, w) in enumerate(blocks)])
        ).alias("k"),
    ).select("fp", "k.*")
    big = checkpointed(first.groupBy("b", "v").count().filter(F.col("count") > bucket))
    plain = [none.alias("b2"), none.alias("v2"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp"]
    if big.isEmpty():
        return first.select("b", "v", *plain)
    small = first.join(big, ["b", "v"], "left_anti").select("b", "v", *plain)
    narrow = 64 - min(w for _, w in blocks)
    second = first.join(big.drop("count"), ["b", "v"]).select(
        "b", "v", "fp",
        F.explode(
            F.array(*[F.struct(F.lit(b).cast("long").alias("b2"), _bits(F.col("rest"), o, w).alias("v2"))
                      for b, (o, w) in enumerate(_blocks(narrow, limit + 1))])
        ).alias("k"),
    ).select("b", "v", "k.*", "fp")
    keys = ["b", "v", "b2", "v2"]
    sizes = second.groupBy(*keys).agg(F.ceil(F.count("*") / bucket).cast("int").alias("chunks"))
    dealt = second.join(sizes, keys).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *keys,
        F.least("c", "o").alias("i"),
        F.greatest("c", "o").alias("j"),
        F.when(F.col("c") > F.col("o"), 1).otherwise(0).alias("side"),
        "fp",
    )
    return small.unionByName(pairs)


def fingerprint_stars(fps: DataFrame, limit: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) links of distinct fingerprints, enough to span every component."""
    group = ["b", "v", "b2", "v2", "i", "j"]
    dealt = _in_buckets(fps, limit, bucket).repartition(*group).sortWithinPartitions(*group, "side")

    def run(batches):
        key, held, out = None, [], []

        def close():
            side = np.concatenate([s for s, _ in held])
            fp = np.concatenate([f for _, f in held]).view(np.uint64)
            query = fp[side == 1]
            if key[4] != key[5] and not len(query):
                return
            a, b = bucket_stars(fp[side == 0], query if len(query) else None, limit) if (side == 0).any() else (fp[:0], fp[:0])
            if len(a):
                out.append((a.view(np.int64), b.view(np.int64)))

        def flush():
            a, b = (np.concatenate(x) for x in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in cols[:6]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                now = tuple(c[lo] for c in cols[:6])
                if now != key:
                    if held and sum(len(s) for s, _ in held) > 1:
                        close()
                    key, held = now, []
                held.append((cols[6][lo:hi], cols[7][lo:hi]))
            if sum(len(a) for a, _ in out) > 50_000:
                yield flush()
        if held and sum(len(s) for s, _ in held) > 1:
            close()
        if out:
            yield flush()

    return dealt.select(*group, "side", "fp").mapInArrow(run, "u long, v long")


def _meet(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """An equi join with a side that has one row per key: the rows of a hot
    key are spread over ``SALTS`` tasks, and the other side is sent to each."""
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    every = right.withColumn("__salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return salted.join(every, [key, "__salt"]).drop("__salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge with the smallest node reachable.
    Alternating large-star and small-star until the edges stand still."""
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _meet(both, low, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _meet(large, low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, limit: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id and group_fp (the group's own fingerprint,
    its name where ids are null or repeated) for every row."""
    rows = checkpointed(fingerprints(docs, shingle))
    per_fp = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(fingerprint_stars(per_fp.select("fp"), limit, bucket))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())  # a root is of its group
    linked = per_fp.join(roots, F.col("fp") == F.col("node")).select("fp", "first_id", "root")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    grouped = _meet(linked, smallest, "root", "fp").select(F.col("fp").alias("__fp"), "root", "least_id")
    of_fp = checkpointed(
        per_fp.join(grouped, F.col("fp") == F.col("__fp"), "left").select(
            "fp",
            "n",
            # a linked group without any id has no least id
            F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"),
            F.coalesce("root", "fp").alias("group_fp"),
        )
    )
    # Fingerprints of more than a 500th of all rows, fewer than 500, are
    # broadcast, so their rows are found where they are.
    most = (per_fp.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = of_fp.filter(F.col("n") > most).select(F.col("fp").alias("__hot"), F.col("component_id").alias("c"), F.col("group_fp").alias("g"))
    if most == 0:  # no more rows than HOT_SHARE: nothing is hot
        return rows.join(of_fp.drop("n"), "fp").select("doc_id", "fp", "component_id", "group_fp")
    found = rows.join(F.broadcast(hot), F.col("fp") == F.col("__hot"), "left")
    met = found.filter("__hot is not null").select("doc_id", "fp", F.col("c").alias("component_id"), F.col("g").alias("group_fp"))
    rest = found.filter("__hot is null").select("doc_id", "fp").join(of_fp.filter(F.col("n") <= most).drop("n"), "fp")
    return met.unionByName(rest.select("doc_id", "fp", "component_id", "group_fp"))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, limit: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """The documents with one row of every near-duplicate group: the row of
    the smallest id. Texts stay where they are while the ids to remove are
    few enough to broadcast; beyond that it is a join on doc_id.

    If ids are null or repeated, rows are told apart by (id, fingerprint)."""
    groups = checkpointed(near_groups(docs, shingle, limit, bucket))
    rows, ids = groups.agg(F.count("*"), F.count("doc_id")).first()
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone_id"))
    doubled = rows != ids or not groups.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if not doubled:
        return join_checked(docs, gone, F.col("doc_id") == F.col("__gone_id"), "left_anti", F.lit(16)).select(*docs.columns)
    keep = groups.groupBy("group_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias("__keep_id"), F.col("k.fp").alias("__keep_fp"))
    own = F.col("doc_id").eqNullSafe(F.col("__keep_id")) & (F.col("__fp") == F.col("__keep_fp"))
    return with_fingerprint(docs, shingle).join(keep, own).dropDuplicates(["doc_id", "__fp"]).select(*docs.columns)
