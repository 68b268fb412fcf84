from collections import defaultdict

from histscore.llm import sharding as S
from tests.llm.helpers import no_docs, odd_docs, odd_rows


def check(rows, limit):
    shards = defaultdict(list)
    for r in rows:
        assert len(r.shard) == r.depth
        shards[r.shard].append(r.bytes)
    for name, sizes in shards.items():
        assert sum(sizes) <= limit or len(sizes) == 1
        if name:  # the parent was too large, else it would not have split
            inside = [r.bytes for r in rows if r.shard.startswith(name[:-1])]
            assert sum(inside) > limit
    for a in shards:  # prefix-free: one shard per hash
        assert not any(b != a and b.startswith(a) for b in shards)


def test_splits_only_what_is_too_large(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(4000)], "doc_id long, text string")
    rows = S.assign_shards(docs, 2000).collect()
    assert len(rows) == 4000
    check(rows, 2000)
    assert all(r.shard_bytes == sum(x.bytes for x in rows if x.shard == r.shard) for r in rows[:20])


def test_hot_id_and_odd_rows(spark, tmp_path):
    hot = [(1, "y" * 50)] * 1000 + [(i, "y" * 50) for i in range(2, 2000)]
    rows = S.assign_shards(spark.createDataFrame(hot, "doc_id long, text string"), 3000).collect()
    check(rows, 3000)
    odd = S.assign_shards(odd_docs(spark), 5000).collect()
    assert len(odd) == len(odd_rows())
    check(odd, 5000)
    assert [r.over_limit for r in odd if r.doc_id == 7] == [True]
    S.write_shards(odd_docs(spark), str(tmp_path / "out"), 5000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(odd_rows())
    assert S.assign_shards(no_docs(spark)).count() == 0
