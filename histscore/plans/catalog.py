"""The query catalogue: importing the query modules fills the registry."""

from __future__ import annotations

from histscore.plans import q_axis, q_blend, q_history, q_io, q_learn, q_runs, q_seq  # noqa: F401
from histscore.plans.q_history import flagship  # noqa: F401
from histscore.plans.registry import ORACLE, QUERIES
from histscore.plans.sqlkit import bigint_count_if


def spark_queries():
    return dict(QUERIES)


def oracle_queries():
    return {k: bigint_count_if(v) for k, v in ORACLE.items() if k in QUERIES}
