import glob
import os

import pytest

from litlens.operators.upsert import touched, upsert_table


def _files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*/*.parquet")}


def test_few_keys_rewrite_few_buckets(spark, tmp_dir):
    path = os.path.join(tmp_dir, "labels")
    rows = spark.range(2000).selectExpr("id as paper_id", "'topic' as category", "1 as run", "'old' as label")
    upsert_table(spark, path, rows, buckets=32)
    before = _files(path)
    assert len({os.path.dirname(f) for f in before}) == 32
    # the ids arrive as another type; the bucket is the same
    new = spark.range(10).selectExpr("cast(id * 7 as int) as paper_id", "'topic' as category", "1 as run", "'new' as label")
    upsert_table(spark, path, new)
    after = _files(path)
    changed = {os.path.dirname(f) for f, _ in set(before.items()) ^ set(after.items())}
    assert 1 <= len(changed) <= 10
    got = {r.paper_id: r.label for r in spark.read.parquet(path).collect()}
    assert got == {i: "new" if i % 7 == 0 and i < 70 else "old" for i in range(2000)}
    with pytest.raises(ValueError):
        upsert_table(spark, path, new, buckets=16)


def test_only_named_partitions_are_read(spark, tmp_dir):
    path = os.path.join(tmp_dir, "labels")
    rows = spark.range(200).selectExpr("id as paper_id", "'topic' as category", "1 as run", "'old' as label")
    upsert_table(spark, path, rows, buckets=8)
    target = spark.read.parquet(path)
    few = target.filter("paper_id = 3")
    parts = ["category", "run", "bucket_of_8"]
    plan = touched(target, few, parts)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("], ")[0]
    assert "bucket_of_8" in filters
    assert touched(target, few.limit(0), parts).count() == 0
    with pytest.raises(ValueError):
        plain = os.path.join(tmp_dir, "plain")
        upsert_table(spark, plain, rows)
        upsert_table(spark, plain, rows, buckets=4)
