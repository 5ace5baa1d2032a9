"""Aggregate and window operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from retailops.operators import aggs as A


def test_number_rows_consecutive_over_many_tasks(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("v"), "id")
    got = A.number_rows(df, ["v", "id"]).select("v", "id", "rn")
    want = df.withColumn("rn2", F.row_number().over(Window.orderBy("v", "id")))
    j = got.join(want, ["v", "id"])
    assert j.count() == 5000
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0


def test_top_rank_keeps_ties(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("b", None), ("b", None)], "g string, v int")
    got = sorted(tuple(r) for r in A.top_rank(df, "g", "v").collect())
    assert got == [("a", 3), ("a", 3), ("b", None), ("b", None)]


def test_with_count_and_dups(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    assert sorted((r.k, r.n) for r in A.with_count(df, "k").collect()) == [(1, 2), (1, 2), (2, 1)]
    assert sorted(r.v for r in A.dup_rows(df, "k").collect()) == ["x", "y"]


def test_scorecard_counts_distinct_keys(spark):
    df = spark.createDataFrame([(1, "F"), (1, "F"), (2, "O"), (3, "F")], "k int, s string")
    r = A.scorecard(df, "k", {"f": F.col("s") == "F", "o": F.col("s") == "O"}, text_name="t").first()
    assert (r.f, r.o, r.t) == (2, 1, "f=2 o=1")


def test_minus_and_union_distinct(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,)], "k int")
    assert [r.k for r in A.minus(a, b).collect()] == [1]
    assert A.union_distinct(a, b).count() == 2


def test_number_rows_per_group_with_a_hot_group(spark):
    # one group holds a third of the rows; numbering must restart per group and be consecutive
    df = spark.range(0, 6000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
        (F.col("id") * 7919 % 6007).alias("v"), "id")
    got = A.number_rows(df, ["v", "id"], partition_by=["g"]).select("g", "v", "id", "rn")
    want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    j = got.join(want, ["g", "v", "id"])
    assert j.count() == 6000
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0


def test_hot_key_aggregate_join_back_operators(spark):
    df = spark.range(0, 3000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 100).alias("k"), "id")
    n_hot = df.where("k = 7").count()
    wc = {r.k: r.n for r in A.with_count(df, "k").where("k = 7").select("k", "n").distinct().collect()}
    assert wc == {7: n_hot}
    top = A.top_rank(df, "k", "id").where("k = 7").collect()
    assert [r.id for r in top] == [df.where("k = 7").agg(F.max("id")).first()[0]]
    assert A.dup_rows(df, "k").where("k = 7").count() == n_hot


def test_number_rows_is_lossless_with_a_payload(spark):
    # 600,000 rows and columns outside the order, in every shuffle setting that once lost rows
    df = spark.range(0, 600_000, numPartitions=7).select(
        (F.col("id") * 7919 % 600_011).alias("v"), "id", F.concat(F.lit("payload-"), "id").alias("text"),
        (F.col("id") % 3).alias("g"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for aqe, size in (("true", "64MB"), ("false", "64MB"), ("true", "1MB")):
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            r = A.number_rows(df, ["v", "id"]).agg(
                F.count("*"), F.countDistinct("rn"), F.min("rn"), F.max("rn"), F.countDistinct("text")).first()
            assert tuple(r) == (600_000, 600_000, 1, 600_000, 600_000), (aqe, size)
            got = A.number_rows(df, ["v", "id"], partition_by=["g"]).groupBy("g").agg(
                F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.max("rn").alias("m")).collect()
            assert [(x.n, x.d, x.m) for x in got] == [(200_000,) * 3] * 3
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_fact_totals_read_a_fact_once(spark):
    base, fact = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(0, 2.0), (0, 3.0), (1, 4.0)], "k long, v double")
    out = A.fact_totals(base, {"all": (fact, ["k"], F.col("v")), "big": (fact, ["k"], F.when(F.col("v") > 2, F.col("v")))}, 0.0)
    assert sorted(map(tuple, out.collect())) == [(0, 5.0, 3.0), (1, 4.0, 4.0), (2, 0.0, 0.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
