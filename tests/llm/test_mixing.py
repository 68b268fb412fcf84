import pytest

from histscore.llm import mixing as M
from tests.llm.helpers import no_docs, odd_docs, odd_rows, split


def brute_targets(sizes: dict, weights=(1, 2, 3), rate=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = [s for s in order if s not in capped]
        level = (total - sum(rate * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in left))
        above = {s for s in left if level * weight[s] > rate * sizes[s]}
        if not above:
            return {s: float(rate * sizes[s]) if s in capped else level * weight[s] for s in order}
        capped |= above


def test_odd_rows(spark):
    rows = M.mix_counts(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    sizes: dict = {}
    for r in odd_rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(split(r[1]))
    target = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        rate = target[r.source] / r.source_size if r.source_size else 0
        assert int(rate + 1e-9) <= r.copies <= min(3, int(rate) + 1)
        assert r.taken == r.size * r.copies <= 3 * r.size
    assert sorted(map(str, M.mix_counts(odd_docs(spark)).collect())) == sorted(map(str, rows))


def test_emits_what_it_counts(spark):
    docs = odd_docs(spark)
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in M.mix_counts(docs).collect() for _ in range(r.copies))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in mixed.collect()) == want


def test_near_target_and_one_hot_source(spark):
    rows = [(i, "w " * (1 + i % 50), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken: dict = {}
    target: dict = {}
    for r in M.mix_counts(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.03)


def test_empty(spark):
    assert M.mix_counts(no_docs(spark)).count() == 0
    assert M.mix_documents(no_docs(spark)).count() == 0
