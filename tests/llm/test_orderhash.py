import hashlib

import xxhash
from pyspark.sql import functions as F

from histscore.llm import orderhash as O
from tests.llm.helpers import no_docs, odd_docs, odd_rows, split, words


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints and strings, chained from seed 42."""
    import struct

    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def brute(text):
    """The signature, straight from the definition."""
    w = split(text)
    n = max(len(w) - O.K + 1, min(len(w), 1))
    mask = ~((1 << O.PLACE_BITS) - 1)
    seen: dict = {}
    items = []
    for i in range(n):
        h = spark_hash(*[w[i + j] if i + j < len(w) else None for j in range(O.K)]) & mask
        o = seen[h] = seen.get(h, -1) + 1
        items.append(((spark_hash((h,), o) & mask), i))
    out = []
    for b in range(O.BINS):
        own = sorted(x for x in items if (x[0] % (1 << 64)) >> (64 - O.BIN_BITS) == b)[: O.PICK]
        if own:
            own.sort(key=lambda x: x[1])
            out.append(b * 65536 + (spark_hash(*[(h,) for h, _ in own]) & 0xFFFF))
    return out


def test_signature_matches_brute_force(spark):
    texts = [words(n, n) for n in (1, 2, 3, 5, 40, 300)] + ["a b a b a b a b", "x " * 500, "", None, " \n ", "à é " * 30]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.s for r in df.select("k", O.signature(F.coalesce("t", F.lit(""))).alias("s")).collect()}
    for k, t in enumerate(texts):
        assert sorted(got[k]) == sorted(brute(t)), t


def test_order_matters(spark):
    a, b = words(200, 1), words(200, 2)
    rows = [("same", a + " " + b), ("swapped", b + " " + a), ("other", words(400, 3))]
    df = spark.createDataFrame(rows, "k string, t string").select("k", O.signature(F.col("t")).alias("s"))
    s = {r.k: set(r.s) for r in df.collect()}
    like = lambda x, y: len(s[x] & s[y]) / O.BINS
    assert 0.2 < like("same", "swapped") < 0.9 and like("same", "other") < 0.1


def check(spark, docs, rows, bucket_rows):
    got = O.fingerprint_edits(docs, bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    order = sorted(((i is None, -(i or 0)), t or "") for i, t in rows)
    ids = {k for k, _ in order}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.n_chars < 2:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
    if len(ids) == len(rows):
        texts = [t for _, t in order]
        by = {(r.doc_id is None, -(r.doc_id or 0)): r for r in got}
        for k, (key, t) in enumerate(order):
            after, h = texts[(k + 1) % len(texts)], len(t) // 2
            edited = t[: len(t) - h] + after[:h]
            assert by[key].n_chars == len(t)
            assert by[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_next_document_over_buckets(spark):
    rows = [(k * k * 3 - 500, words(20 + k % 9, k)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bucket_rows in (1, 7, 5000):
        check(spark, docs, rows, bucket_rows)
    check(spark, docs.limit(1), [tuple(docs.limit(1).collect()[0])], 10)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    check(spark, odd_docs(spark), rows, 3)
    check(spark, odd_docs(spark), rows, 2048)
    once = [r for r in rows if r[0] not in (3, 9, None)] + [(None, "no id here")]
    check(spark, spark.createDataFrame(once, "doc_id long, text string"), once, 2)
    got = {r.doc_id: r for r in O.fingerprint_edits(odd_docs(spark)).collect()}
    assert got[1].fingerprint == got[2].fingerprint
    assert got[5].fingerprint == "" == got[6].fingerprint
    assert O.fingerprint_edits(no_docs(spark)).count() == 0


def test_hot_and_null_ids_are_split(spark):
    """One id holds a third of the rows, the null id another fifth: buckets
    stay small, and each row's neighbour is that of the whole order."""
    ids = [7] * 100 + [None] * 60 + [-3] * 30 + [500 + 3 * k for k in range(110)]
    for extra in ([], [1000] * 90, [-9] * 90):
        rows = [(i, words(12, 1000 + k)) for k, i in enumerate(ids + extra)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        tied = docs.withColumn("tie", F.xxhash64("text"))
        largest = tied.groupBy(O.order_bucket(tied, 10)).count().agg(F.max("count")).first()[0]
        assert largest <= len(rows) / 10
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -spark_hash(r[1])))
        after = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
        for bucket_rows in (10, 50, 5000):
            got = O.with_next(tied, ["text"], bucket_rows).collect()
            assert len(got) == len(rows) and all(r.next_text == after[r.text] for r in got)


def test_no_python_in_the_plan(spark):
    plan = O.fingerprint_edits(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
