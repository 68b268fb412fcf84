"""Labelled ids without a history are fitted, scored and submitted."""

import pyarrow as pa
import pyarrow.parquet as pq

from histscore.plans import q_learn as Q
from tests.conftest import SF_SMALL


def test_ids_without_a_history_are_kept(spark, tmp_path):
    for name in ("orders", "lineitem"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{name}.parquet"), tmp_path / f"{name}.parquet")
    customer = pq.read_table(f"{SF_SMALL}/customer.parquet")
    at = customer.schema.get_field_index("c_custkey")
    fresh = customer.slice(0, 40)
    fresh = fresh.set_column(at, customer.schema.field(at), pa.array(range(10_000_000, 10_000_040), customer.schema.field(at).type))
    both = pa.concat_tables([customer, fresh])
    pq.write_table(both, tmp_path / "customer.parquet")
    ids = both["c_custkey"].to_pylist()
    sf = str(tmp_path)
    table, _ = Q.labelled_features(spark, sf)
    assert sorted(r.id for r in table.select("id").collect()) == sorted(ids)
    sent = Q.q_submission_text(spark, sf).collect()
    assert sorted(r.id for r in sent) == sorted(ids)
    (r,) = Q.q_complete_check_submission(spark, sf).collect()
    assert (r.rows, r.null_predictions, r.missing_ids) == (len(ids), 40, 40)
