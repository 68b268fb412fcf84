import numpy as np
import pytest
import xxhash

from histscore.llm import simhash as S
from tests.llm.helpers import no_docs, odd_docs, odd_rows, real_docs, split, words


def brute_fp(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in split(text)]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, limit=4):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    for t in [r["text"] for r in real_docs()[:40]] + [r[1] for r in odd_rows()[:17] if len(r[1] or "") < 9000]:
        assert S.fingerprint(t) == brute_fp(t)


def near(rng, n, centres=6, flips=6):
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(base[rng.integers(centres)])
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            x ^= 1 << int(b)
        out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("seed", range(4))
def test_index_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    fps = near(rng, 400)
    fps = fps[np.argsort(S.gray_rank(fps))]
    query = near(np.random.default_rng(seed), 150)
    pairs, whole = S.GrayIndex(fps).search(query, 4)
    got = set(zip(*(p.tolist() for p in pairs)))
    for q, a, b in whole:
        for i, lo, hi in zip(q.tolist(), a.tolist(), b.tolist()):
            got |= {(i, k) for k in range(lo, hi)}
    want = {(i, j) for i, x in enumerate(query.tolist()) for j, y in enumerate(fps.tolist()) if (x ^ y).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("bucket", [2048, 40, 8])
def test_components_at_any_bucket_size(spark, bucket):
    fps = near(np.random.default_rng(9), 500, centres=12, flips=8)
    want = brute_groups(fps.tolist())
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in S.components(S.fingerprint_stars(df, 4, bucket)).collect()}
    got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    pairs = {(a, b) for a, b in zip(want, got)}
    assert len(pairs) == len(set(want)) == len(set(got))


def test_groups_of_real_and_odd_rows(spark):
    real = real_docs()
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in real], "doc_id long, text string")
    fps = [brute_fp(r["text"]) for r in real]
    root = brute_groups(fps)
    least = {}
    for r, k in zip(real, root):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = {r["doc_id"]: (f, least[k]) for r, f, k in zip(real, fps, root)}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in S.near_groups(docs).collect()}
    assert got == want
    kept = S.keep_one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_odd_rows_keep_one_each(spark):
    docs = odd_docs(spark)
    assert S.near_groups(docs).count() == len(odd_rows())
    fps = [brute_fp(r[1]) if len(r[1] or "") < 9000 else S.fingerprint(r[1]) for r in odd_rows()]
    root = brute_groups(fps)
    kept = S.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len(set(root))
    assert 1 in [r.doc_id for r in rows] and 2 not in [r.doc_id for r in rows]
    assert S.near_groups(no_docs(spark)).count() == 0
    assert S.keep_one_of_each(no_docs(spark)).count() == 0


def test_long_chain_is_one_component(spark):
    # each differs from the next by 4 bits only
    chain, x = [], 0
    for k in range(40):
        chain.append(x)
        for b in range(4):
            x ^= 1 << ((4 * k + b) % 64)
    fps = sorted({c - (1 << 64) if c >= 1 << 63 else c for c in chain})
    got = S.components(S.fingerprint_stars(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    assert {r.root for r in got} == {min(fps)} and len(words(1, 1))


def test_hot_fingerprints_and_centres(spark):
    """A third of all rows are copies of one text, and a star of near texts."""
    import random

    r = random.Random(6)
    base = words(300, 1).split()
    rows = [(k, " ".join(base)) for k in range(500, 800)]
    for k in range(60):
        near = list(base)
        near[r.randrange(300)] = f"z{k}"
        rows.append((k, " ".join(near)))
    rows += [(1000 + k, words(40, 100 + k)) for k in range(640)]
    got = S.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    fps = {}
    for g in got:
        fps.setdefault(g.fp % 2**64, []).append(g.doc_id)
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    each = sorted(fps)
    for k, a in enumerate(each):
        for b in each[k + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                group[root(a)] = root(b)
    least = {}
    for f, ids in fps.items():
        least[root(f)] = min([least.get(root(f), 10**9), *ids])
    assert {g.doc_id: g.component_id for g in got} == {i: least[root(f)] for f, ids in fps.items() for i in ids}
