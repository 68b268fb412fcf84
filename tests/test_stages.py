"""Durable stages: reuse by a later session, rebuilding on change."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from histscore.sources.stages import stage
from histscore.sources.tables import input_key


@pytest.fixture
def root(spark, tmp_path):
    spark.conf.set("spark.histscore.stage.dir", str(tmp_path / "stages"))
    yield tmp_path
    spark.conf.unset("spark.histscore.stage.dir")


def test_a_second_session_reuses_the_stage_and_changes_rebuild_it(spark, root):
    built = []

    def table(n):
        pq.write_table(pa.table({"id": list(range(n))}), root / "events.parquet")

    def rows(session, k=1):
        def build(path):
            built.append(path)
            session.read.parquet(str(root / "events.parquet")).selectExpr(f"id * {k} as v").write.parquet(path)

        key = {"input": input_key(session, str(root), ["events"]), "k": k}
        return sorted(r.v for r in session.read.parquet(stage(session, "scaled", key, build)).collect())

    table(3)
    assert rows(spark) == [0, 1, 2] and len(built) == 1
    other = spark.newSession()
    other.conf.set("spark.histscore.stage.dir", str(root / "stages"))
    assert rows(other) == [0, 1, 2] and len(built) == 1  # reused
    assert rows(other, 5) == [0, 5, 10] and len(built) == 2  # another parameter
    table(4)
    assert rows(spark) == [0, 1, 2, 3] and len(built) == 3  # other input


def test_a_broken_attempt_is_never_read(spark, root):
    def broken(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stage(spark, "part", {"a": 1}, broken)
    path = stage(spark, "part", {"a": 1}, lambda p: spark.range(7).write.parquet(p))
    assert spark.read.parquet(path).count() == 7


def test_the_first_commit_counts(spark, root):
    def slow(path):
        spark.range(1).write.parquet(path)
        inner = stage(spark, "race", {"a": 1}, lambda p: spark.range(2).write.parquet(p))
        assert spark.read.parquet(inner).count() == 2

    path = stage(spark, "race", {"a": 1}, slow)
    assert spark.read.parquet(path).count() == 2
