"""DuckDB SQL for the role bindings (the oracle side of plans/bindings.py)."""

from __future__ import annotations

CTES: dict[str, str] = {
    "event_codes": """
        SELECT event_type, CAST(row_number() OVER (ORDER BY event_type NULLS FIRST) - 1 AS SMALLINT) AS f_type
        FROM (SELECT DISTINCT event_type FROM events)""",
    "history_a": """
        SELECT e.user_id AS id,
               CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS INTEGER) AS rn,
               c.f_type,
               CAST(CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS SMALLINT) AS f_k,
               CAST(hour(e.ts) AS SMALLINT) AS f_hour,
               CAST(floor(e.value / 25) AS SMALLINT) AS f_val
        FROM events e JOIN event_codes c ON e.event_type IS NOT DISTINCT FROM c.event_type""",
    "history_b": """
        SELECT o.o_custkey AS id,
               CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, l.l_orderkey,
                    l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity,
                    l.l_extendedprice) AS INTEGER) AS rn,
               o.o_orderpriority AS type,
               CAST(CASE l.l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS SMALLINT) AS state,
               CAST(round(l.l_discount * 100) AS SMALLINT) AS util,
               CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_quantity >= 40 THEN 1 ELSE 0 END AS SMALLINT) AS overdue,
               l.l_quantity AS x
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
    "type_codes": """
        SELECT type, CAST(row_number() OVER (ORDER BY type NULLS FIRST) - 1 AS SMALLINT) AS type_code
        FROM (SELECT DISTINCT o_orderpriority AS type FROM orders)""",
    "history_b_coded": """
        SELECT h.*, c.type_code FROM history_b h JOIN type_codes c ON h.type IS NOT DISTINCT FROM c.type""",
    "target_dense": """
        SELECT c_custkey AS id, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS SMALLINT) AS flag
        FROM customer""",
    "target_sparse": """
        SELECT doc_id AS id, CAST(toxic AS SMALLINT) AS flag FROM labels""",
    "query_ids": """
        SELECT d.doc_id AS id, row_number() OVER (ORDER BY d.doc_id) AS ord
        FROM documents d WHERE d.doc_id NOT IN (SELECT id FROM target_sparse)""",
    "customer_scores": """
        SELECT id, avg(util) AS discount, avg(overdue) AS overdue_rate, max(x) AS max_qty,
               CAST(count(*) AS DOUBLE) AS n_lines
        FROM history_b GROUP BY id""",
    "preds": """
        SELECT u.model,
               CASE WHEN ((u.id % 10) + 10) % 10 = 0 THEN 'valid' ELSE 'test' END AS split,
               u.id, t.flag AS target, CAST(u.prediction AS DOUBLE) AS prediction, u.id AS ord
        FROM (UNPIVOT customer_scores ON discount, overdue_rate, max_qty, n_lines
              INTO NAME model VALUE prediction) u
        JOIN target_dense t ON t.id = u.id""",
}

DEPENDS: dict[str, list[str]] = {
    "history_a": ["event_codes"],
    "query_ids": ["target_sparse"],
    "history_b_coded": ["history_b", "type_codes"],
    "customer_scores": ["history_b"],
    "preds": ["customer_scores", "target_dense"],
}


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPENDS.get(name, []):
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_roles(roles: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH <roles...>, <extra...> <body>``."""
    parts = [f"{name} AS ({CTES[name]})" for name in _closure(roles)]
    parts += [f"{name} AS ({sql})" for name, sql in extra]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
