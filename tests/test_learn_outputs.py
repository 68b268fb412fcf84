"""The learners' own results, against brute force on the scored rows."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from histscore.operators import learn as L
from histscore.plans import q_learn as Q
from histscore.plans.sqlkit import auc_sql
from tests.conftest import SF_SMALL


def pair_auc(rows, score="score"):
    pos, neg = ([r[score] for r in rows if r["flag"] == k] for k in (1, 0))
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def query(spark, name):
    return E.queries()[name](spark, SF_SMALL).collect()


def planted(spark, n=900):
    """x decides the flag but for every eleventh row; z is noise."""
    rows = [(k, int((k * 37 % 100) > 60) ^ (k % 11 == 0), float(k * 37 % 100), float(k * 53 % 17), k % 3 == 0) for k in range(n)]
    return spark.createDataFrame(rows, "id long, flag int, x double, z double, is_valid boolean")


def test_margins_and_best_iteration_on_planted_features(spark):
    table = planted(spark)
    valid = table.where("is_valid")
    booster = L.boost(table.where("not is_valid"), valid, ["x", "z"], 12, min_instances=5)
    last = max(k for k, _ in booster.curve)
    staged = booster.staged(valid, ["id", "flag"]).collect()
    for k, value in booster.curve:
        assert value == pytest.approx(pair_auc([r for r in staged if r.iteration == k], "margin"), abs=1e-12)
    assert booster.best == next(k for k, v in booster.curve if v == max(v for _, v in booster.curve))
    # The score is that of the iteration the model is cut to, and the margin
    # after the last tree is the library's own.
    cut = {r.id: r.margin for r in staged if r.iteration == booster.best}
    got = {r.id: r.score for r in booster.score(valid).collect()}
    assert got == pytest.approx({i: 1 / (1 + math.exp(-2 * m)) for i, m in cut.items()}, abs=1e-12)
    prob = {r.id: r.probability[1] for r in booster.model.transform(valid).collect()}
    end = {r.id: 1 / (1 + math.exp(-2 * r.margin)) for r in staged if r.iteration == last}
    assert prob == pytest.approx(end, abs=1e-9)
    ranked = L.importances(booster.model)
    assert ranked[0][0] == "x" and pair_auc(booster.score(valid).collect()) > 0.8


def test_early_stop():
    curve = list(enumerate([0.5, 0.6, 0.6, 0.55, 0.7, 0.7, 0.69, 0.68, 0.9], start=1))
    assert L.stop_early(curve, 100) == (9, curve)
    assert L.stop_early(curve, 3) == (5, curve[:8])
    assert L.stop_early(curve, 2) == (2, curve[:4])
    assert L.stop_early([(1, None), (2, None)], 3) == (2, [(1, None), (2, None)])


def test_gbt_queries_against_brute_force(spark):
    booster, table, feats = Q.fitted(spark, SF_SMALL)
    scored = [r.asDict() for r in Q.tagged_scores(booster, table).collect()]
    for r in query(spark, "gbt_metrics"):
        want = pair_auc([x for x in scored if x["tag"] == r.tag])
        assert r.auc is None if want is None else r.auc == pytest.approx(want, abs=1e-9)
        assert (r.best_iteration, r.feature_count) == (booster.best, len(feats))
    margins = booster.staged(table.where("is_valid"), ["id", "flag"]).collect()
    curve = query(spark, "gbt_curve")
    assert sorted(r.iteration for r in curve) == list(range(1, Q.GBT_ITER + 1))
    for r in curve:
        want = pair_auc([m for m in margins if m.iteration == r.iteration], "margin")
        assert r.auc is None if want is None else r.auc == pytest.approx(want, abs=1e-9)
    assert [r.iteration for r in curve if r.is_best] == [booster.best]
    (summary,) = query(spark, "gbt_run_summary")
    by_tag = {r.tag: r for r in query(spark, "gbt_metrics")}
    assert summary.random_auc == by_tag["random"].auc and summary.temporal_valid_rows == by_tag["temporal"].rows
    assert (summary.best_iteration, summary.train_rows) == (booster.best, table.where("not is_valid").count())


def test_feature_selection_is_applied(spark):
    booster, table, feats = Q.fitted(spark, SF_SMALL)
    everything = query(spark, "feature_importances")
    assert [(r.feature, r.importance) for r in sorted(everything)] == L.importances(booster.model)
    assert sorted(r.feature for r in everything) == sorted(feats)
    top = sorted(query(spark, "feature_select"))
    assert [(r.rank, r.feature, r.importance) for r in top] == [tuple(r) for r in sorted(everything)[: Q.TOP_K]]
    small, _, _ = Q.fitted(spark, SF_SMALL, sliced=[r.feature for r in top])
    assert {n for n, _ in L.importances(small.model)} == {r.feature for r in top}
    for name, model in (("auc_all", booster), ("auc_top", small)):
        want = pair_auc(model.score(table.where("is_valid")).collect())
        assert len({r[name] for r in top}) == 1
        assert top[0][name] is None if want is None else top[0][name] == pytest.approx(want, abs=1e-9)


def test_cross_fitted_submission_covers_every_id(spark):
    scored = Q.cross_fitted(spark, SF_SMALL).collect()
    table, _ = Q.labelled_features(spark, SF_SMALL)
    ids = [r.id for r in table.select("id").collect()]
    assert sorted(r.id for r in scored) == sorted(ids)
    sent = query(spark, "submission_text")
    assert {r.id: float(r.flag) for r in sent} == pytest.approx({r.id: r.score for r in scored}, abs=1e-17)
    assert sorted(r.ord for r in sent) == list(range(1, len(ids) + 1))
    assert [r.id for r in sorted(sent)] != sorted(ids)
    for r in query(spark, "cross_fit_auc"):
        want = pair_auc([x for x in scored if x.part == r.part])
        assert r.auc is None if want is None else r.auc == pytest.approx(want, abs=1e-9)


def test_cross_scores_come_from_models_that_did_not_see_the_row(spark):
    table = planted(spark, 300).withColumnRenamed("is_valid", "unused").selectExpr("*", "cast(id % 3 as int) as part")
    seen = {}

    class Fake:
        def __init__(self, ids):
            self.ids = ids

        def score(self, df, name):
            assert not self.ids & {r.id for r in df.select("id").collect()}
            return df.selectExpr("*", f"cast(id as double) as {name}")

    def fit(k, rows):
        seen[k] = {r.id for r in rows.select("id").collect()}
        return Fake(seen[k])

    assert L.cross_scores(table, "part", 3, fit).count() == 300
    assert all(len(v) == 200 for v in seen.values())


def test_an_unscored_sample_id_fails(spark):
    sample = Q.sample_file(spark, SF_SMALL)
    some = sample.selectExpr("id", "0.25D as flag")
    assert Q.submitted(spark, sample, some).count() == sample.count()
    gone = some.first().id
    with pytest.raises(ValueError, match="1 sample ids without a prediction"):
        Q.submitted(spark, sample, some.where(f"id <> {gone}"))


def test_learners_by_feature_set(spark):
    scored = Q.learner_scores(spark, SF_SMALL)
    rows = [r.asDict() for r in scored.collect()]
    con = duckdb.connect()
    con.register("s", scored.toPandas())
    again = dict(con.execute(f"SELECT features, auc FROM ({auc_sql('s', 'score', 'flag', ['features'])})").fetchall())
    got = {r.features: r for r in query(spark, "learners_auc")}
    assert set(got) == {"pooled", "multi_hot", "bins"}
    for name, r in got.items():
        mine = [x for x in rows if x["features"] == name]
        assert (r.rows, r.n_pos) == (len(mine), sum(x["flag"] for x in mine))
        want = pair_auc(mine)
        if want is not None:
            assert r.auc == pytest.approx(want, abs=1e-9) and again[name] == pytest.approx(want, abs=1e-9)
    ab = [r.asDict() for r in Q.ab_scores(spark, SF_SMALL).collect()]
    for r in query(spark, "ab_models_auc"):
        want = pair_auc([x for x in ab if (x["part"], x["variant"]) == (r.part, r.variant)])
        assert r.auc is None if want is None else r.auc == pytest.approx(want, abs=1e-9)


def test_sparse_learner_finds_a_planted_code(spark):
    rows = [(k, k % 2, [str(3 + k % 4), str(40 + k % 2)] * (1 + k % 3)) for k in range(200)]
    table = spark.createDataFrame(rows, "id long, flag int, tokens array<string>").selectExpr("id", "cast(flag as double) as flag", "tokens")
    model = L.sparse_pipeline(range(50)).fit(table)
    scored = model.transform(table)
    vector = scored.first().features
    assert vector.size == 50 and len(vector.indices) == 2
    assert pair_auc(L.positive_probability(scored).select("flag", "score").collect()) == 1.0


def test_padded_tensors_and_masked_forward(spark):
    seqs = [(1, [[1, 2], [3, 4]], 2), (2, [[5, 6], [0, 0]], 1), (3, [[0, 0], [0, 0]], 0)]
    df = spark.createDataFrame(seqs, "id long, seq array<array<smallint>>, len smallint").coalesce(1)

    def forward(x, valid, params):
        assert x.shape[1:] == (2, 2) and valid.shape == x.shape[:2]
        return (x.sum(axis=2) * valid).sum(axis=1) * params["k"]

    got = {r.id: r.score for r in L.score_sequences(df, forward, {"k": 10.0}, rows=2).collect()}
    assert got == {1: 100.0, 2: 110.0, 3: 0.0}
    params = {"tables": [np.eye(8), np.ones((8, 8))], "head": np.arange(8.0), "bias": 1.0}
    got = {r.id: r.score for r in L.score_sequences(df, L.embedding_forward, params).collect()}
    want = {1: (1 + 3) / 2 + 28 + 1, 2: 5 + 28 + 1, 3: 1.0}
    assert got == pytest.approx({k: 1 / (1 + math.exp(-v)) for k, v in want.items()})
