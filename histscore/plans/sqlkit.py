"""Reusable DuckDB oracle fragments."""

from __future__ import annotations


def auc_sql(src: str, score: str, label: str, by: list[str] = (), name: str = "auc") -> str:
    """Exact tie-aware AUC grouped by ``by`` over relation ``src``."""
    by = list(by)
    lead = ", ".join(by) + ", " if by else ""
    part = "PARTITION BY " + ", ".join(by) if by else ""
    group = "GROUP BY " + ", ".join(by) if by else ""
    return f"""SELECT {lead}CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE)
                  / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS {name}
        FROM (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY s
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
              FROM (SELECT {lead}{score} AS s,
                           sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS pos,
                           sum(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS neg
                    FROM {src} GROUP BY {lead}{score}))
        {group}"""


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def weighted_sql(terms) -> str:
    return " + ".join(f"{dbl(w)} * {c}" for w, c in terms)


def bigint_count_if(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(coalesce(..., 0) AS BIGINT)``:
    DuckDB returns HUGEINT there, and NULL when every input is NULL, where
    Spark returns a BIGINT 0."""
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(token) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append(f"CAST(coalesce({sql[j:k + 1]}, 0) AS BIGINT)")
        i = k + 1
