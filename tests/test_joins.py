"""Join operators on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailops.operators import joins as J


def test_not_in_null_semantics(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted(r.k for r in J.not_in(left, "k", spark.createDataFrame([(2,)], "k int")).collect()) == [1]
    # a null on the right: no rows at all
    assert J.not_in(left, "k", spark.createDataFrame([(2,), (None,)], "k int")).count() == 0
    # empty subquery: every row, the null one too
    assert J.not_in(left, "k", spark.createDataFrame([], "k int")).count() == 3


def test_lookup_default_and_two_values_error(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = {r.k: r.v for r in J.lookup(df, dim, "k", "v", default="-").collect()}
    assert got == {1: "a", 2: "b", 3: "-"}
    bad = spark.createDataFrame([(1, "a"), (1, "z")], "k int, v string")
    with pytest.raises(Exception):
        J.lookup(df, bad, "k", "v").collect()


def test_either_key_join_counts_pair_once(spark):
    left = spark.createDataFrame([(1, 1, 2), (2, 3, 3)], "id int, a int, b int")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, n string")
    got = sorted((r.id, r.n) for r in J.either_key_join(left, right, ["a", "b"], "k").collect())
    assert got == [(1, "x"), (1, "y"), (2, "z")]


def test_asof_join_end_rules(spark):
    left = spark.createDataFrame([(1, dt.date(2024, 1, 10))], "k int, d date")
    right = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 1, 10), 5.0)], "k int, f date, t date, p double")
    assert J.asof_join(left, right, ["k"], "d", "f", "t", end="exclusive").count() == 0
    assert J.asof_join(left, right, ["k"], "d", "f", "t", end="inclusive").count() == 1


def test_lookup_latest_and_first_are_deterministic(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    hist = spark.createDataFrame([(1, 1, 10.0), (1, 3, 7.0), (1, 3, 9.0)], "k int, o int, v double")
    assert {r.k: r.v for r in J.lookup_latest(df, hist, "k", "o", "v", default=0.0).collect()} == {1: 9.0, 2: 0.0}
    assert {r.k: r.v for r in J.lookup_first(df, hist, "k", ["o"], "v", default=-1.0).collect()} == {1: 10.0, 2: -1.0}


def test_checked_broadcast_respects_bound(spark):
    small = spark.range(10)
    big = spark.range(1000)
    assert "broadcast" in J.checked_broadcast(small, 1000)._jdf.queryExecution().logical().toString().lower()
    plan = J.checked_broadcast(big, 1000).join(small, "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower()


def test_cross_param_requires_one_row(spark):
    for n in (0, 2):
        with pytest.raises(Exception, match="exactly one row"):
            J.cross_param(spark.range(3), spark.range(n).withColumnRenamed("id", "p")).count()
    assert J.cross_param(spark.range(3), spark.range(1).select(F.lit(7).alias("p"))).count() == 3


def test_bucketed_asof_equals_plain_asof(spark):
    import random
    rnd = random.Random(3)
    base = dt.date(2020, 1, 1)
    iv = []
    for k in range(5):
        start = base - dt.timedelta(days=400)
        while start < base + dt.timedelta(days=900):
            length = rnd.randint(1, 120)
            iv.append((k, start, start + dt.timedelta(days=length), float(rnd.randint(1, 99))))
            start += dt.timedelta(days=length)
        iv.append((k, start, dt.date(9999, 12, 31), 0.5))   # open-ended last row
    pts = [(rnd.randint(0, 5), base + dt.timedelta(days=rnd.randint(-30, 1000))) for _ in range(800)]
    right = spark.createDataFrame(iv, "k int, f date, t date, p double")
    left = spark.createDataFrame(pts, "k int, d date")
    for end in ("exclusive", "inclusive"):
        for how in ("inner", "left"):
            a = J.asof_join(left, right, ["k"], "d", "f", "t", end=end, how=how, bucket_days=31)
            b = J.asof_join(left, right, ["k"], "d", "f", "t", end=end, how=how, bucket_days=None)
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())), (end, how)
            # a span that leaves out many of the days changes the cost only
            c = J.asof_join(left, right, ["k"], "d", "f", "t", end=end, how=how, span=("2020-06-01", "2020-09-30"))
            assert sorted(map(tuple, c.collect())) == sorted(map(tuple, b.collect())), (end, how)


def test_lookup_fails_on_any_second_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    for rows in ([(1, 5), (1, 5)], [(1, 5), (1, None)]):
        dim = spark.createDataFrame(rows, "k int, v int")
        with pytest.raises(Exception, match="more than one row per key"):
            J.lookup(df, dim, "k", "v").collect()
    dim = spark.createDataFrame([(1, 5), (9, 1), (9, 1)], "k int, v int")  # key 9 is not looked up
    assert {r.k: r.v for r in J.lookup(df, dim, "k", "v").collect()} == {1: 5, 2: None}
