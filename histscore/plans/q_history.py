"""Queries over history tables: A1-A6, W1-W2, H1-H14, J1, P2, C1/C2."""

from __future__ import annotations

from pyspark.sql import functions as F

from histscore.functions.scalar import fold
from histscore.operators import history as H
from histscore.operators.checks import assert_unique
from histscore.operators.metrics import auc
from histscore.plans import bindings as B
from histscore.plans.oracle_ctes import with_roles
from histscore.plans.registry import register

FIELDS_B = B.HISTORY_B_NUMERIC
STATES = [0, 1, 2]


# ---------------------------------------------------------------- A1-A5
_agg_sql_cols = ", ".join(
    [f"avg({f}) AS {f}__mean" for f in FIELDS_B] + [f"max({f}) AS {f}__max" for f in FIELDS_B]
)


@register(
    "history_agg",
    with_roles(
        ["history_b"],
        f"SELECT id, count(*) AS loan_count, max(rn) AS rn_max, {_agg_sql_cols} "
        "FROM history_b GROUP BY id",
    ),
)
def q_history_agg(spark, sf_dir):
    return H.history_aggregate(B.history_b(spark, sf_dir), FIELDS_B)


_agg_a_cols = ", ".join(
    [f"avg({f}) AS {f}__mean" for f in B.HISTORY_A_FIELDS]
    + [f"max({f}) AS {f}__max" for f in B.HISTORY_A_FIELDS]
)


@register(
    "history_agg_events",
    with_roles(
        ["history_a"],
        f"SELECT id, count(*) AS loan_count, max(rn) AS rn_max, {_agg_a_cols} "
        "FROM history_a GROUP BY id",
    ),
)
def q_history_agg_events(spark, sf_dir):
    return H.history_aggregate(B.history_a(spark, sf_dir), B.HISTORY_A_FIELDS)


# ---------------------------------------------------------------- A6
@register(
    "first_pos_count",
    """SELECT o_custkey AS id, min(o_orderkey) AS first_pos, count(*) AS n
       FROM orders GROUP BY o_custkey""",
)
def q_first_pos_count(spark, sf_dir):
    orders = B.read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return H.first_pos_count(
        orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"))
    )


# ---------------------------------------------------------------- P2, J1
@register(
    "hash_fold",
    with_roles(
        ["target_dense"],
        """SELECT ((id % 10) + 10) % 10 = 0 AS is_valid, count(*) AS n_ids,
                  CAST(sum(flag) AS BIGINT) AS n_pos
           FROM target_dense GROUP BY 1""",
    ),
)
def q_hash_fold(spark, sf_dir):
    t = B.target_dense(spark, sf_dir)
    return t.groupBy((fold("id") == 0).alias("is_valid")).agg(
        F.count(F.lit(1)).alias("n_ids"), F.sum("flag").cast("long").alias("n_pos")
    )


@register(
    "label_join",
    with_roles(
        ["history_b", "target_dense"],
        f"""SELECT t.id, a.* EXCLUDE (id, loan_count), coalesce(a.loan_count, 0) AS loan_count, t.flag
           FROM (SELECT id, count(*) AS loan_count, max(rn) AS rn_max, {_agg_sql_cols}
               FROM history_b GROUP BY id) a RIGHT JOIN target_dense t ON a.id = t.id""",
    ),
)
def q_label_join(spark, sf_dir):
    """Labels and features, both keys checked unique (1:1). Every label
    is kept: one without a history (at sf0.1 a customer without orders) is
    reported as a row with ``loan_count`` 0 and null features."""
    feats = H.history_aggregate(B.history_b(spark, sf_dir), FIELDS_B)
    target = B.target_dense(spark, sf_dir)
    assert_unique(feats, ["id"])
    assert_unique(target, ["id"])
    joined = target.join(feats, "id", "left").select(*feats.columns, "flag")
    return joined.withColumn("loan_count", F.coalesce("loan_count", F.lit(0).cast("long")))


# ---------------------------------------------------------------- flagship
FLAGSHIP_SQL = with_roles(
    ["history_b", "target_dense"],
    """SELECT CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc,
              CAST(sum(pos) + sum(neg) AS BIGINT) AS n_valid, CAST(sum(pos) AS BIGINT) AS n_pos
       FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                                AND 1 PRECEDING), 0) AS below
             FROM (SELECT a.score, sum(CASE WHEN t.flag = 1 THEN 1 ELSE 0 END) AS pos,
                          sum(CASE WHEN t.flag = 1 THEN 0 ELSE 1 END) AS neg
                   FROM (SELECT id, avg(state) AS score FROM history_b GROUP BY id) a
                   JOIN target_dense t USING (id)
                   WHERE ((a.id % 10) + 10) % 10 = 0
                   GROUP BY a.score))""",
)


def flagship(spark, sf_dir):
    """History B -> per-id aggregates -> label join -> validation fold ->
    score = mean payment state -> exact AUC."""
    feats = H.history_aggregate(B.history_b(spark, sf_dir), FIELDS_B)
    labelled = feats.join(B.target_dense(spark, sf_dir), "id")
    valid = labelled.where(fold("id") == 0).select(
        "id", F.col("state__mean").alias("score"), F.col("flag").alias("target")
    )
    scored = auc(valid, score="score", label="target", counts=True)
    return scored.select(
        "auc", (F.col("n_pos") + F.col("n_neg")).alias("n_valid"), "n_pos"
    )


register("auc_flagship", FLAGSHIP_SQL)(flagship)


# ---------------------------------------------------------------- W1, W2
LAST_N = 8


@register(
    "last_n",
    with_roles(
        ["history_b"],
        f"""SELECT id, rn, state, x, pos_desc FROM (
              SELECT id, rn, state, x, row_number() OVER (PARTITION BY id ORDER BY rn DESC) AS pos_desc
              FROM history_b) WHERE pos_desc <= {LAST_N}""",
    ),
)
def q_last_n(spark, sf_dir):
    h = B.history_b(spark, sf_dir).select("id", "rn", "state", "x")
    return H.last_n(h, LAST_N).withColumn("pos_desc", F.col("pos_desc").cast("long"))


# ---------------------------------------------------------------- H1-H4
SEQ_FIELDS = ["state", "util", "x"]


@register(
    "h_last",
    with_roles(
        ["history_b"],
        "SELECT id, "
        + ", ".join(f"arg_max({f}, rn) AS {f}__last" for f in FIELDS_B)
        + " FROM history_b GROUP BY id",
    ),
)
def q_h_last(spark, sf_dir):
    return H.last_values(B.history_b(spark, sf_dir), FIELDS_B)


@register(
    "h_last3",
    with_roles(
        ["history_b"],
        "SELECT id, "
        + ", ".join(f"avg({f}) AS {f}__last3" for f in FIELDS_B)
        + """ FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn DESC) AS p FROM history_b)
              WHERE p <= 3 GROUP BY id""",
    ),
)
def q_h_last3(spark, sf_dir):
    return H.last_k_mean(B.history_b(spark, sf_dir), FIELDS_B, 3)


@register(
    "h_std",
    with_roles(
        ["history_b"],
        "SELECT id, "
        + ", ".join(f"round(stddev_samp({f}), 6) AS {f}__std" for f in FIELDS_B)
        + " FROM history_b GROUP BY id",
    ),
)
def q_h_std(spark, sf_dir):
    return H.select_rounded(H.dispersion(B.history_b(spark, sf_dir), FIELDS_B))


@register(
    "h_payment",
    with_roles(
        ["history_b"],
        """SELECT id, CAST(sum(state) AS BIGINT) AS state__sum, max(state) AS state__max,
                  avg(state) AS state__mean, CAST(sum(overdue) AS BIGINT) AS overdue__sum,
                  avg(overdue) AS overdue__mean, arg_max(state, rn) AS state__last
           FROM history_b GROUP BY id""",
    ),
)
def q_h_payment(spark, sf_dir):
    return H.payment_summary(B.history_b(spark, sf_dir))


# ---------------------------------------------------------------- H5-H7
# The order-priority vocabulary of the driver tables.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
UTIL_BINS = list(range(0, 11))


def _freq_sql(column: str, values, prefix: str) -> str:
    parts = []
    for v in values:
        lit = f"'{v}'" if isinstance(v, str) else str(v)
        parts.append(
            f"count_if({column} = {lit}) / count(*) AS {prefix}__freq_{H._safe(v)}"
        )
    parts.append(f"count_if({_other_sql(column, values)}) / count(*) AS {prefix}__freq_other")
    return ", ".join(parts)


def _other_sql(column: str, values) -> str:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"coalesce({column} NOT IN ({listed}), true)"


@register(
    "h_category_freq",
    with_roles(
        ["history_b"],
        f"SELECT id, {_freq_sql('type', PRIORITIES, 'type')} FROM history_b GROUP BY id",
    ),
)
def q_h_category_freq(spark, sf_dir):
    return H.category_frequencies(B.history_b(spark, sf_dir), "type", PRIORITIES)


@register(
    "h_util_hist",
    with_roles(
        ["history_b"],
        f"SELECT id, {_freq_sql('util', UTIL_BINS, 'util')} FROM history_b GROUP BY id",
    ),
)
def q_h_util_hist(spark, sf_dir):
    return H.category_frequencies(B.history_b(spark, sf_dir), "util", UTIL_BINS)


@register(
    "h_state_freq",
    with_roles(
        ["history_b"],
        f"SELECT id, {_freq_sql('state', STATES, 'state')} FROM history_b GROUP BY id",
    ),
)
def q_h_state_freq(spark, sf_dir):
    return H.category_frequencies(B.history_b(spark, sf_dir), "state", STATES)


# ---------------------------------------------------------------- H9-H13
def _tv_sql(f: str) -> str:
    """Total variation; integer fields sum to BIGINT as in Spark."""
    tv = f"coalesce(sum(abs({f} - {f}__prev)), 0)"
    return tv if f == "x" else f"CAST({tv} AS BIGINT)"



_LAGGED = "history_lag AS (SELECT *, " + ", ".join(
    f"lag({f}) OVER (PARTITION BY id ORDER BY rn) AS {f}__prev" for f in FIELDS_B
) + " FROM history_b)"


def _with_lag(body: str) -> str:
    sql = with_roles(["history_b"], body)
    return sql.replace("\nSELECT", ",\n" + _LAGGED + "\nSELECT", 1)


@register(
    "h_deltas",
    _with_lag(
        "SELECT id, "
        + ", ".join(f"arg_max({f}, rn) - arg_min({f}, rn) AS {f}__delta" for f in SEQ_FIELDS)
        + ", "
        + ", ".join(f"arg_max({f}__prev, rn) AS {f}__prev_last" for f in SEQ_FIELDS)
        + " FROM history_lag GROUP BY id"
    ),
)
def q_h_deltas(spark, sf_dir):
    return H.deltas(B.history_b(spark, sf_dir), SEQ_FIELDS)


@register(
    "h_trend",
    _with_lag(
        "SELECT id, "
        + ", ".join(
            f"round(regr_slope({f}, rn), 6) AS {f}__slope, "
            f"{_tv_sql(f)} AS {f}__tv, "
            f"count_if({f} <> {f}__prev) AS {f}__changes"
            for f in SEQ_FIELDS
        )
        + " FROM history_lag GROUP BY id"
    ),
)
def q_h_trend(spark, sf_dir):
    return H.select_rounded(
        H.trend(B.history_b(spark, sf_dir), SEQ_FIELDS), keep=["id"] + [f"{f}__tv" for f in SEQ_FIELDS]
    )


def _transition_sql() -> str:
    counts = ", ".join(
        f"count_if(state__prev = {a} AND state = {b}) AS state__t{a}{b}"
        for a in STATES
        for b in STATES
    )
    terms = " + ".join(
        f"CASE WHEN count_if(state = {s}) > 0 THEN -(count_if(state = {s}) / count(*)) "
        f"* ln(count_if(state = {s}) / count(*)) ELSE 0 END"
        for s in STATES
    )
    return f"SELECT id, {counts}, round({terms}, 6) AS state__entropy FROM history_lag GROUP BY id"


@register("h_transitions", _with_lag(_transition_sql()))
def q_h_transitions(spark, sf_dir):
    return H.select_rounded(H.transitions(B.history_b(spark, sf_dir), "state", STATES))


@register(
    "h_since_overdue",
    with_roles(
        ["history_b"],
        """SELECT id, count(*) - max(CASE WHEN overdue > 0 THEN rn END) AS since_overdue
           FROM history_b GROUP BY id""",
    ),
)
def q_h_since_overdue(spark, sf_dir):
    return H.since_last_flag(B.history_b(spark, sf_dir), "overdue")


@register(
    "h_by_type",
    with_roles(
        ["history_b"],
        "SELECT id, "
        + ", ".join(
            f"avg(CASE WHEN type = '{v}' THEN util END) AS util__mean_{H._safe(v)}, "
            f"CAST(sum(CASE WHEN type = '{v}' THEN overdue ELSE 0 END) AS BIGINT) AS overdue__sum_{H._safe(v)}"
            for v in PRIORITIES
        )
        + f", avg(CASE WHEN {_other_sql('type', PRIORITIES)} THEN util END) AS util__mean_other, "
        + f"CAST(sum(CASE WHEN {_other_sql('type', PRIORITIES)} THEN overdue ELSE 0 END) AS BIGINT) AS overdue__sum_other"
        + " FROM history_b GROUP BY id",
    ),
)
def q_h_by_type(spark, sf_dir):
    return H.by_category(B.history_b(spark, sf_dir), "type", PRIORITIES, "util", "overdue")


# ---------------------------------------------------------------- H14
def _wide_sql() -> str:
    plain = ["count(*) AS loan_count", "max(rn) AS rn_max"]
    for f in SEQ_FIELDS:
        plain += [
            f"avg({f}) AS {f}__mean",
            f"max({f}) AS {f}__max",
            f"round(stddev_samp({f}), 6) AS {f}__std",
            f"arg_max({f}, rn) AS {f}__last",
            f"arg_max({f}, rn) - arg_min({f}, rn) AS {f}__delta",
            f"round(regr_slope({f}, rn), 6) AS {f}__slope",
            f"{_tv_sql(f)} AS {f}__tv",
            f"count_if({f} <> {f}__prev) AS {f}__changes",
        ]
    for v in PRIORITIES:
        plain.append(f"count_if(type = '{v}') / count(*) AS type__freq_{H._safe(v)}")
        plain.append(f"avg(CASE WHEN type = '{v}' THEN util END) AS util__mean_{H._safe(v)}")
    for s in STATES:
        plain.append(f"count_if(state = {s}) / count(*) AS state__freq_{s}")
    for column, values in (("type", PRIORITIES), ("state", STATES)):
        plain.append(f"count_if({_other_sql(column, values)}) / count(*) AS {column}__freq_other")
    plain.append(f"avg(CASE WHEN {_other_sql('type', PRIORITIES)} THEN util END) AS util__mean_other")
    plain.append("count(*) - max(CASE WHEN overdue > 0 THEN rn END) AS since_overdue")
    plain += [
        f"count_if(state__prev = {a} AND state = {b}) AS state__t{a}{b}"
        for a in STATES
        for b in STATES
    ]
    return "SELECT id, " + ", ".join(plain) + " FROM history_lag GROUP BY id"


@register("h_wide", _with_lag(_wide_sql()))
def q_h_wide(spark, sf_dir):
    return wide_table(spark, sf_dir)


def wide_table(spark, sf_dir, also=()):
    """H14, with the aggregates ``also`` from the same pass."""
    wide = H.wide_features(
        B.history_b(spark, sf_dir, previous=SEQ_FIELDS, ordered=True),
        SEQ_FIELDS,
        "type",
        PRIORITIES,
        "state",
        STATES,
        "overdue",
        "util",
        also=also,
    )
    rounded = [f"{f}__std" for f in SEQ_FIELDS] + [f"{f}__slope" for f in SEQ_FIELDS]
    return wide.select(
        *[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in wide.columns]
    )
