"""Properties: partition independence, invariances, leak safety, round trips."""

import numpy as np
from pyspark.sql import functions as F

from histscore.functions.scalar import fold
from histscore.operators import axis as X
from histscore.operators import sequences as S
from histscore.operators.metrics import auc
from histscore.operators.ordering import global_row_number, running_totals
from histscore.plans import bindings as B
from tests.conftest import SF_CHECK


def test_running_totals_independent_of_ranges(spark):
    preds = B.preds(spark, SF_CHECK)
    results = []
    for ranges in (1, 3, 17):
        out = running_totals(preds, ["prediction", "id"], ["target"], ["model"], ranges=ranges)
        results.append(sorted((r.model, r.id, r.before_target) for r in out.collect()))
    assert results[0] == results[1] == results[2]


def test_running_totals_match_numpy(spark):
    preds = B.preds(spark, SF_CHECK).where(F.col("model") == "n_lines").toPandas()
    df = spark.createDataFrame(preds)
    out = running_totals(df, ["prediction", "id"], ["target"], ranges=5).toPandas()
    expected = preds.sort_values(["prediction", "id"]).assign(
        before=lambda d: d["target"].cumsum() - d["target"]
    )
    merged = out.merge(expected, on="id")
    assert (merged["before_target"] == merged["before"]).all()


def test_row_numbers_are_a_permutation(spark):
    ids = B.target_dense(spark, SF_CHECK)
    out = global_row_number(ids, ["id"], ranges=7, count_name="n").collect()
    assert sorted(r.row_number for r in out) == list(range(1, len(out) + 1))
    assert {r.n for r in out} == {len(out)}


def test_auc_invariant_under_monotone_transform(spark):
    p = B.preds(spark, SF_CHECK).where("split = 'valid' AND model = 'discount'")
    a = auc(p).first().auc
    b = auc(p.withColumn("prediction", F.exp(F.col("prediction") * 3) - 7)).first().auc
    assert a == b


def test_auc_matches_pairwise_count(spark):
    pdf = B.preds(spark, SF_CHECK).where("split = 'valid' AND model = 'max_qty'").toPandas()
    pos = pdf.loc[pdf.target == 1, "prediction"].to_numpy()
    neg = pdf.loc[pdf.target == 0, "prediction"].to_numpy()
    diff = pos[:, None] - neg[None, :]
    expected = ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size
    got = auc(spark.createDataFrame(pdf), ranges=3).first().auc
    assert abs(got - expected) < 1e-12


def test_prior_ignores_excluded_labels(spark):
    labels = B.target_sparse(spark, SF_CHECK)
    excluded = labels.where(fold("id") == 0)
    flipped = labels.withColumn(
        "flag", F.when(fold("id") == 0, 1 - F.col("flag")).otherwise(F.col("flag"))
    )
    a = X.centred_prior(X.included_labels(labels, excluded), excluded, 50, 20.0)
    b = X.centred_prior(X.included_labels(flipped, excluded), excluded, 50, 20.0)
    assert sorted(a.collect()) == sorted(b.collect())


def test_bins_tile_the_outer_range(spark):
    labels = B.target_sparse(spark, SF_CHECK)
    queries = B.query_ids(spark, SF_CHECK).limit(40)
    widths, half = (4, 8), 3
    bins = X.multi_scale_bins(labels, queries, widths, half).toPandas()
    lab = labels.toPandas()
    ids = np.sort(lab["id"].to_numpy())
    for (qid, w), grp in bins.groupby(["id", "width"]):
        lo = qid - half * w - w // 2
        hi = qid + (half + 1) * w - w // 2
        expected = int(((ids >= lo) & (ids < hi)).sum())
        assert int(grp["count"].sum()) == expected


def test_pack_round_trip(spark):
    h = B.history_b_coded(spark, SF_CHECK)
    packed = S.pack_sequences(h, B.SEQ_FIELDS_B, 16)
    cells = S.explode_cells(packed, B.SEQ_FIELDS_B)
    back = cells.groupBy("id").agg(F.count(F.lit(1)).alias("cells"))
    expected = h.groupBy("id").agg((F.least(F.count(F.lit(1)), F.lit(16)) * 4).alias("cells"))
    assert back.exceptAll(expected).count() == 0


def test_shuffle_partitions_do_not_change_results(spark):
    from histscore.plans.catalog import spark_queries

    q = spark_queries()
    names = ["rank_pct", "id_prior", "blend_grid"]
    before = {n: sorted(map(tuple, q[n](spark, SF_CHECK).collect())) for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        after = {n: sorted(map(tuple, q[n](spark, SF_CHECK).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert before == after


def test_axis_block_sizes_agree(spark):
    labels = B.target_sparse(spark, SF_CHECK)
    queries = B.query_ids(spark, SF_CHECK)
    sizes = [7, 333, 1 << 15]
    priors = [sorted(X.centred_prior(labels, queries, 50, 20.0, block_size=b).collect()) for b in sizes]
    assert priors[0] == priors[1] == priors[2]
    bins = [sorted(X.multi_scale_bins(labels, queries, (4, 16, 300), 3, block_size=b).drop("density").collect()) for b in sizes]
    assert bins[0] == bins[1] == bins[2]
    prefixes = [sorted(X.prefix_table(labels, **f).collect()) for f in (dict(block_size=7), dict(block_size=1 << 15), dict(ranges=5))]
    assert prefixes[0] == prefixes[1] == prefixes[2]


def test_window_sums_against_brute_force(spark):
    rng = np.random.default_rng(3)
    ids = sorted({int(x) for x in rng.integers(-500, 3000, 700)} | {10**12})
    flags = {i: int(rng.integers(0, 2)) for i in ids}
    asked = [*ids[::5], -10_000, 2999, 10**12 - 3, 10**15]
    labels = spark.createDataFrame([(i, f) for i, f in flags.items()] + [(None, 1)], "id long, flag int")
    queries = spark.createDataFrame([(q,) for q in asked] * 2 + [(None,)], "id long")
    for size in (16, 4096):
        got = X.bin_arrays(labels, queries, (3, 64), 4, own_targets=labels, block_size=size).collect()
        assert len(got) == 2 * len(asked)
        for r in got:
            for k, (total, n) in enumerate(zip(r.sums, r.counts)):
                lo = r.id + (k - 4) * r.width - r.width // 2
                inside = [flags[i] for i in ids if lo <= i < lo + r.width and not (k == 4 and i == r.id)]
                assert (total, n) == (sum(inside), len(inside)), (r.id, r.width, k)


def test_running_totals_match_a_sorted_cumsum_per_model(spark):
    preds = B.preds(spark, SF_CHECK)
    got = sorted(
        (r.model, r.id, r.before_target)
        for r in running_totals(preds, ["prediction", "id"], ["target"], ["model"], ranges=3).collect()
    )
    pdf = preds.toPandas().sort_values(["model", "prediction", "id"])
    pdf["expected"] = pdf.groupby("model")["target"].cumsum() - pdf["target"]
    assert got == sorted(zip(pdf["model"], pdf["id"], pdf["expected"].astype(int)))


def _odd_rows(spark):
    """Null groups, null keys, ids above 2**53 and one hot score."""
    big = 2**53
    rows = [(g, None if i % 7 == 0 else (i % 5) / 2 if i % 3 else 1.0, big + i, i % 2) for i in range(60) for g in ("a", None, "b")]
    return spark.createDataFrame(rows, "g string, score double, id long, v int")


def test_ranges_null_groups_and_large_ids_give_the_windows_answer(spark):
    from pyspark.sql import Window

    df = _odd_rows(spark)
    w = Window.partitionBy("g").orderBy("score", "id")
    want = df.withColumn("before_v", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    want = want.withColumn("tot_v", F.sum("v").over(Window.partitionBy("g")))
    for ranges in (1, 3, 17):
        got = running_totals(df, ["score", "id"], ["v"], ["g"], ranges=ranges, totals_prefix="tot_")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert {r.id for r in got.collect()} == {2**53 + i for i in range(60)}


def test_decimal_sums_stay_exact(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(i, Decimal("0.10")) for i in range(30)], "id int, v decimal(12,2)")
    got = {r.id: r.before_v for r in running_totals(df, ["id"], ["v"], ranges=4).collect()}
    assert got[29] == Decimal("2.90")


def test_range_form_is_jvm_only(spark):
    plan = running_totals(B.preds(spark, SF_CHECK), ["prediction", "id"], ["target"], ["model"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct"))


def test_numbering_inside_many_groups_matches_window(spark):
    from pyspark.sql import Window

    from histscore.operators.ordering import number_within

    h = B.history_b(spark, SF_CHECK).select("id", "rn", "state", "x")
    shuffled = h.select("id", (F.col("rn") * 7919 % 100003).alias("key"), "rn")
    w = Window.partitionBy("id").orderBy("key", "rn")
    want = sorted(map(tuple, shuffled.withColumn("row_number", F.row_number().over(w)).collect()))
    for ranges in (3, 64):
        got = global_row_number(shuffled, ["key", "rn"], ["id"], ranges=ranges)
        assert sorted(map(tuple, got.collect())) == want
        split = number_within(shuffled, "id", ["key", "rn"], name="row_number", split=True, ranges=ranges)
        assert sorted(map(tuple, split.collect())) == want


def test_numbering_keeps_null_keys(spark):
    from histscore.operators.ordering import number_within

    df = spark.createDataFrame([(None if i % 3 == 0 else i % 2, i) for i in range(60)], "k int, o int")
    plain = sorted(map(str, number_within(df, "k", ["o"]).collect()))
    assert len(plain) == 60
    assert sorted(map(str, number_within(df, "k", ["o"], split=True, ranges=9).collect())) == plain


def test_previous_row_with_gaps_and_null_ids(spark):
    from histscore.operators.history import since_last_flag, with_previous

    places = [p for p in range(1, 2100) if p not in (1024, 1025, 2048)]
    rows = [(k, p, p) for p in places for k in (1, None)]
    df = spark.createDataFrame(rows, "id long, rn int, x int")
    got = {(r.id, r.rn): r.x__prev for r in with_previous(df, ["x"]).collect()}
    for before, p in zip([None, *places], places):
        assert got[1, p] == before == got[None, p]
    flags = spark.createDataFrame([(1, 1, 0), (1, 40, 1), (1, 90, 0), (1, 95, 0)], "id long, rn int, overdue int")
    assert since_last_flag(flags).first().since_overdue == 2


def test_hash_epochs_samples_and_masks_behave_like_chance(spark):
    ids = spark.range(0, 4000)
    plan = S.batch_plan(ids, 2, 1, 10, 5).toPandas()
    order = [plan[plan.epoch == e].sort_values(["batch_key", "id"]).id.tolist() for e in (1, 2)]
    place = {x: k for k, x in enumerate(order[1])}
    shifts = {(place[x] - k) % len(order[0]) for k, x in enumerate(order[0])}
    assert len(shifts) > 1000  # not a rotation
    samples = S.fixed_samples(spark.range(0, 1000), 8, 100, 3).toPandas()
    by = [set(samples[samples.step == s].id) for s in range(1, 9)]
    overlaps = [len(a & b) for i, a in enumerate(by) for b in by[:i]]
    assert 7 < sum(overlaps) / len(overlaps) < 13 and max(overlaps) < 25
    cells = ids.select("id", F.lit(1).alias("pos"), F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("field"))
    hit = S.field_mask(cells.withColumn("value", F.lit(1).cast("short")), 0.15, 9).groupBy("id").agg(F.sum(F.col("is_masked").cast("int")).alias("n"))
    n = hit.toPandas().n
    assert 0.08 < (n >= 2).mean() < 0.14 and 0.45 < (n == 0).mean() < 0.60  # binomial: 0.11 and 0.52


def test_rank_loss_has_no_group_limit(spark):
    from histscore.operators.metrics import pairwise_rank_loss

    rng = np.random.default_rng(2)
    rows = [(int(g), float(round(s, 2)), int(s + rng.normal() > 0)) for g in range(2) for s in rng.normal(size=300)] + [(9, 1.0, 1)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    want = {9: 0.0}
    for g in range(2):
        pos = np.array([s for k, s, y in rows if k == g and y == 1])
        neg = np.array([s for k, s, y in rows if k == g and y != 1])
        want[g] = float(np.logaddexp(0, neg[None, :] - pos[:, None]).mean())
    for block in (7, 64, 4096):
        got = {r.g: r.rank_loss for r in pairwise_rank_loss(df, "s", "y", ["g"], block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_auc_refuses_null_and_nan(spark):
    import pytest

    for bad in ((None, 1), (float("nan"), 0), (0.5, None)):
        df = spark.createDataFrame([(0.1, 0), (0.9, 1), bad], "prediction double, target int")
        with pytest.raises(Exception, match="AUC needs"):
            auc(df).collect()


def test_repeated_label_counts_once(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0)], "id long, flag int")
    out = X.centred_prior(labels, spark.createDataFrame([(1,)], "id long"), 2, 20.0).first()
    assert (out.window_count, out.window_sum) == (1, 1)


def test_planted_faults_are_reported(spark):
    from histscore.operators import checks as C

    left = spark.createDataFrame([("m", 1, 0), ("m", 2, 1), ("n", 1, 0)], "model string, id int, target int")
    right = spark.createDataFrame([("m", 1, 0), ("m", 2, 0), ("n", 1, 0), ("n", 3, 1)], "model string, id int, target int")
    got = {r.model: (r.only_left, r.only_right, r.differ) for r in C.alignment_report(left, right, "id", ["target"], by=["model"]).collect()}
    assert got == {"m": (0, 0, 1), "n": (0, 1, 0)}
    swapped = spark.createDataFrame([(0, 8), (1, 7)], "ord int, id int")
    sample = spark.createDataFrame([(0, 7), (1, 8)], "ord int, id int")
    assert C.order_report(swapped, sample, "id", "ord").first().mismatched == 2


def test_exact_quantile_matches_numpy(spark):
    from histscore.operators.split import quantile_border

    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 101):
        ids = rng.integers(0, 50, n)
        df = spark.createDataFrame([(int(i),) for i in ids], "id long")
        assert abs(quantile_border(df, 0.9) - np.quantile(ids, 0.9)) < 1e-9
