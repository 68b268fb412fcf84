"""One narrow pass over the history, stored sequences, margins shuffled as
arrays, and learner queries that do their whole job."""

import datetime as dt
import random

import pytest

import __spark_entry__ as E
from histscore.operators import learn as L
from histscore.operators import ordering as O
from histscore.operators import sequences as S
from histscore.plans import bindings as B
from histscore.plans import q_history, q_seq
from histscore.plans import q_learn as Q
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def fresh_stages(spark, tmp_path):
    spark.conf.set("spark.histscore.stage.dir", str(tmp_path / "stages"))
    yield
    spark.conf.unset("spark.histscore.stage.dir")


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(name) or real(*a, **k))
    return calls


def tables(spark, path):
    """Orders and lines with repeated and null keys; every line has a quantity
    of its own, so the place of each is known."""
    rng = random.Random(5)
    day = lambda k: dt.datetime(2020, 1, 1 + k)
    orders = [(k if k % 17 else None, rng.choice([1, 2, 3, None]), day(rng.randrange(4)), rng.choice(["1-URGENT", "5-LOW", None])) for k in range(60)]
    orders += [(5, 2, day(1), "5-LOW"), (5, 3, day(2), "1-URGENT")]
    lines = [
        (rng.choice([*range(60), None]), rng.randrange(3), rng.randrange(2), rng.randrange(3), rng.randrange(2), float(k), 9.5, 0.05, rng.choice("ANR"), day(2))
        for k in range(700)
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extra int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, names).write.parquet(f"{path}/lineitem.parquet")
    low = lambda *v: tuple((x is not None, x) for x in v)
    want = {}
    for key, cust, date, priority in orders:
        for line in lines:
            if key is not None and line[0] == key:
                order = low(date, key, line[3], line[1], line[2], line[9], line[5], line[6])
                want.setdefault(cust, []).append((order, priority, line))
    return {c: sorted(v, key=lambda r: r[0]) for c, v in want.items()}


@pytest.mark.parametrize("part_rows", [500_000, 40])
def test_history_order_with_repeated_and_null_keys(spark, tmp_path, monkeypatch, part_rows):
    want = tables(spark, tmp_path)
    monkeypatch.setattr(O, "PART_ROWS", part_rows)
    got = B.history_b(spark, str(tmp_path), previous=["x"], ordered=True)
    per = {}
    for r in got.collect():
        per.setdefault(r.id, []).append(r)
    assert {c: len(v) for c, v in per.items()} == {c: len(v) for c, v in want.items()}
    for c, rows in per.items():
        rows.sort(key=lambda r: r.rn)
        assert [r.rn for r in rows] == list(range(1, len(rows) + 1))
        assert [r.x for r in rows] == [line[5] for _, _, line in want[c]]
        assert [r.x__prev for r in rows] == [None, *[r.x for r in rows[:-1]]]
    if part_rows == 40:
        assert "REPARTITION_BY_NUM" in _plan(got)


def test_only_the_line_number_travels_to_the_customer(spark):
    """The columns that break ties stay behind the join, and the
    previous row comes from the numbering's own sort."""
    plan = _plan(B.history_b(spark, SF_SMALL))
    above = plan[: plan.index("Join")]
    assert "l_partkey" not in above and "l_extendedprice" not in above
    wide = _plan(q_history.q_h_wide(spark, SF_SMALL))
    assert wide.count("+- Sort [id#") == 1


def test_both_variants_share_one_pass(spark, fresh_stages, monkeypatch):
    """the A/B tables come from one pass over the history."""
    calls = counted(monkeypatch, B, "history_b")
    base, names = Q.labelled_features(spark, SF_SMALL, "base")
    wide, _ = Q.labelled_features(spark, SF_SMALL, "wide")
    assert len(calls) == 1
    want = q_history.H.history_aggregate(B.history_b(spark, SF_SMALL), B.HISTORY_B_NUMERIC)
    assert names == [c for c in want.columns if c != "id"]
    want = L.prepare_features(want, names)
    mine = base.where(f"loan_count > {L.MISSING}").select("id", *names)
    assert mine.exceptAll(want).count() == 0 and want.exceptAll(mine).count() == 0


def test_learners_read_stored_sequences(spark, fresh_stages, monkeypatch):
    """Sequences are packed once for all learners."""
    calls = counted(monkeypatch, q_seq, "packed")
    Q.learner_scores(spark, SF_SMALL)
    assert len(calls) == 1
    Q.q_pooled_lr_auc(spark, SF_SMALL).collect()
    assert len(calls) == 1


def test_indices_of_a_sequence_are_those_of_its_events(spark):
    p = q_seq.packed(spark, SF_SMALL)
    offsets = S.field_offsets(q_seq.cards(spark, SF_SMALL))
    events = {}
    for r in S.multi_hot(p, offsets).collect():
        events.setdefault(r.id, []).extend(r["indices"])
    whole = p.select("id", S.sequence_indices(offsets).alias("t"))
    assert "Generate" not in _plan(whole)
    assert {r.id: sorted(r.t) for r in whole.collect()} == {i: sorted(v) for i, v in events.items()}


def test_margins_are_dealt_before_the_explode(spark):
    """one array per row is shuffled, not a row per tree."""
    rows = [(k, k % 2, float(k % 7)) for k in range(300)]
    table = spark.createDataFrame(rows, "id long, flag int, x double")
    booster = L.boost(table, table, ["x"], 4, min_instances=5)
    plan = _plan(booster.staged(table, ["id", "flag"]))
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_learner_checks_need_the_auc(spark):
    """the AUC and the fit are part of what is returned."""
    assert {"auc_valid", "has_trees"} <= set(E.queries()["gbt_fit_score"](spark, SF_SMALL).columns)
    assert "auc_valid" in E.queries()["pooled_lr"](spark, SF_SMALL).columns
    assert "auc_valid" in E.queries()["ab_models"](spark, SF_SMALL).columns
    df = spark.createDataFrame([(0.5,), (None,), (1.0,)], "auc double").select(Q._auc_valid())
    assert [r.auc_valid for r in df.collect()] == [True, False, True]


def test_complete_check_scores_with_the_model(spark, monkeypatch):
    """the checked predictions are the fitted model's."""
    calls = counted(monkeypatch, L.Booster, "score")
    (r,) = Q.q_complete_check_submission(spark, SF_SMALL).collect()
    assert calls and r.rows == B.target_dense(spark, SF_SMALL).count()


def test_a_null_id_is_in_no_fold(spark, tmp_path, fresh_stages):
    """A null customer has no label; it is in no fold and fails no learner."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    for name in ("lineitem", "customer"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{name}.parquet"), tmp_path / f"{name}.parquet")
    orders = pq.read_table(f"{SF_SMALL}/orders.parquet")
    at = orders.schema.get_field_index("o_custkey")
    keys = orders["o_custkey"]
    some = pc.if_else(pa.array([k % 50 == 0 for k in range(len(keys))]), pa.scalar(None, keys.type), keys.combine_chunks())
    pq.write_table(orders.set_column(at, "o_custkey", some), tmp_path / "orders.parquet")
    (r,) = Q.q_pooled_lr_auc(spark, str(tmp_path)).collect()
    assert r.rows > 0


def test_a_fit_has_no_task_per_file(spark, monkeypatch):
    """A tree level's tasks and statistics do not grow with the files."""
    cores = spark.sparkContext.defaultParallelism
    rows = [(k, k % 2, float(k % 7)) for k in range(300)]
    table = spark.createDataFrame(rows, "id long, flag int, x double").repartition(4 * cores)
    seen, real = [], L.Pipeline.fit
    monkeypatch.setattr(L.Pipeline, "fit", lambda self, df: seen.append(df) or real(self, df))
    L.boost(table, table, ["x"], 2, min_instances=5)
    assert [df.rdd.getNumPartitions() for df in seen] == [cores]
    assert sorted(tuple(r) for r in seen[0].collect()) == rows
    assert L.fit_parts(table.repartition(1)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(L, "FIT_ROWS", 10)
    assert L.fit_parts(table).rdd.getNumPartitions() == min(4 * cores, max(cores, 30))
