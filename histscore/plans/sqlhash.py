"""DuckDB text of functions.scalar.mix_hash / hash_unit."""

from __future__ import annotations


def mix_hash_sql(*columns: str, seed: int = 0) -> str:
    values = ", ".join(f"CAST(CAST({c} AS BIGINT) AS VARCHAR)" for c in columns)
    return f"CAST('0x' || substr(md5(concat_ws(':', '{int(seed)}', {values})), 1, 8) AS BIGINT)"


def hash_unit_sql(*columns: str, seed: int = 0) -> str:
    return f"({mix_hash_sql(*columns, seed=seed)} >> 16)"
