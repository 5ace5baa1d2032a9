"""Keys from reserved blocks: unique over jobs, the same when a job is repeated, no sort."""

import pytest

from retailops.plans.keyblocks import KeyBlocks
from retailops.session import scratch_path
from retailops.sources.filetables import CommitConflict


def keys(df):
    return sorted((r.k, r.id) for r in df.collect())


def test_keys_are_unique_and_repeat_with_their_job(spark):
    root = scratch_path(spark, "blocks")
    a = spark.range(1000).selectExpr("id % 10 AS k").repartition(7)
    one = keys(KeyBlocks(spark, root, 101).assign(a, "a", "id"))
    two = keys(KeyBlocks(spark, root, 101).assign(spark.range(500).selectExpr("CAST(null AS bigint) k"), "b", "id"))
    again = KeyBlocks(spark, root, 101).assign(a, "a", "id")
    assert keys(again) == one and [k for k, _ in one] == sorted(i % 10 for i in range(1000))
    assert sorted(i for _, i in one) == list(range(101, 1101)) and sorted(i for _, i in two) == list(range(1101, 1601))
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_a_failed_or_rival_job_takes_no_key_twice(spark, monkeypatch):
    root = scratch_path(spark, "blocks")
    rows = spark.range(10).selectExpr("id AS k")
    mine, rival = KeyBlocks(spark, root), KeyBlocks(spark, root)
    commit = mine.log.commit

    def late(base, tables):
        monkeypatch.setattr(mine.log, "commit", commit)
        rival.reserve("rival", 5)  # commits between the reading and the commit of this one
        return commit(base, tables)

    monkeypatch.setattr(mine.log, "commit", late)
    assert sorted(i for _, i in keys(mine.assign(rows, "a", "id"))) == list(range(6, 16))
    monkeypatch.setattr(mine.log, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # rows and blocks are written, the range is not
        mine.assign(rows, "b", "id")
    assert sorted(i for _, i in keys(KeyBlocks(spark, root).assign(rows, "b", "id"))) == list(range(16, 26))
    assert KeyBlocks(spark, root).assign(rows.limit(0), "none", "id").count() == 0
    with pytest.raises(ValueError):
        mine.assign(rows.withColumnRenamed("k", "key_block"), "c", "id")
    with pytest.raises(CommitConflict):
        commit(0, {})
