"""The 18-place text against Python's own, and null categories."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from histscore.functions.scalar import compact_decimal_text
from histscore.plans import bindings as B
from tests.conftest import SF_SMALL


def expected(x):
    t = f"{x:.18f}".rstrip("0").rstrip(".")
    t = "." + t[2:] if t.startswith("0.") else "-." + t[3:] if t.startswith("-0.") else t
    return "0" if t == "-0" else t


def test_exact_eighteen_places(spark):
    r = random.Random(1)
    xs = [0.1, 0.5, 1.0, 0.0, -0.0, -0.25, 1e-18, 5e-19, 1.5e-18, 2.5e-18, 1 - 2**-53, 123456789.125, 2.0**62, 1e-30, -1e-30, 5e-324]
    xs += [r.random() for _ in range(6000)] + [r.uniform(-1e6, 1e6) for _ in range(2000)]
    xs += [r.random() * 10 ** -r.randint(1, 25) for _ in range(3000)] + [r.randrange(1 << 20) * 2.0**-r.randint(1, 64) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(xs)), "k long, v double")
    got = {a.k: a.t for a in df.select("k", compact_decimal_text("v").alias("t")).collect()}
    assert [(x, got[k]) for k, x in enumerate(xs)] == [(x, expected(x)) for x in xs]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1e300,)], "v double")
    assert [a.t for a in odd.select(compact_decimal_text("v").alias("t")).collect()] == [None] * 4


def test_null_categories_keep_every_row(spark, tmp_path):
    for name, column in (("events", "event_type"), ("orders", "o_orderpriority"), ("lineitem", None)):
        table = pq.read_table(f"{SF_SMALL}/{name}.parquet")
        if column:
            at = table.schema.get_field_index(column)
            values = [None if k % 5 == 0 else v for k, v in enumerate(table[column].to_pylist())]
            table = table.set_column(at, column, pa.array(values, table.schema.field(at).type))
        pq.write_table(table, tmp_path / f"{name}.parquet")
    sf = str(tmp_path)
    a = B.history_a(spark, sf).collect()
    assert len(a) == pq.read_metadata(tmp_path / "events.parquet").num_rows
    assert {r.f_type for r in a if r.f_type == 0} == {0} and None not in {r.f_type for r in a}
    assert B.history_b_coded(spark, sf).count() == pq.read_metadata(tmp_path / "lineitem.parquet").num_rows
    of = {}
    for r in a:
        of.setdefault(r.id, []).append(r.rn)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in of.values())
