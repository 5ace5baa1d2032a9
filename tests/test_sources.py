"""Sources and sinks: bucketed co-location, archive retention, fixed width, sizing."""

import datetime as dt

from pyspark.sql import functions as F

from retailops.session import cluster_conf, scratch_path
from retailops.sources import tables as S

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        o = S.bucket_table(S.read_table(spark, SF_SMALL, "orders"), "orders_b", ["o_orderkey"], 8,
                           scratch_path(spark, "orders_b"))
        li = S.bucket_table(S.read_table(spark, SF_SMALL, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"),
                            "lineitem_b", ["o_orderkey"], 8, scratch_path(spark, "lineitem_b"))
        j = o.join(li, "o_orderkey")
        assert "Exchange" not in _plan(j)
        assert j.count() == S.read_table(spark, SF_SMALL, "lineitem").count() - 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_archive_keeps_retention_window(spark):
    root = scratch_path(spark, "arch")
    df = spark.range(5)
    for i in range(4):
        out = S.archive(df, root, dt.date(2024, 1, 1) + dt.timedelta(days=i), keep_days=2)
    stamps = sorted(r.snapshot for r in out.select(F.col("snapshot").cast("string").alias("snapshot")).distinct().collect())
    assert stamps == ["2024-01-02", "2024-01-03", "2024-01-04"]


def test_backup_generations_keep_last_n(spark):
    root = scratch_path(spark, "gens")
    for i in range(5):
        out = S.backup_generations(spark.range(i + 1), root, n=3)
    assert sorted(r.gen for r in out.select("gen").distinct().collect()) == [3, 4, 5]
    assert out.count() == 3 + 4 + 5


def test_fixed_width_round_trip_and_bad_values(spark):
    df = spark.createDataFrame([(12, "ab"), (3, "toolongvalue")], "k int, t string")
    rec = df.select(S.format_fixed([("k", 4, "num"), ("t", 5, "text")]).alias("r"))
    assert [r.r for r in rec.collect()] == ["0012ab   ", "0003toolo"]
    bad = spark.createDataFrame([("00x2ab",)], "r string")
    got = S.parse_fixed(bad, "r", [("k", 1, 4, "int"), ("t", 5, 2)]).first()
    assert got.k is None and got.t == "ab"


def test_keys_in_and_sample_are_repeatable(spark):
    li = S.read_table(spark, SF_SMALL, "lineitem")
    assert S.keys_in(li, "l_partkey", [1, 2, 3]).where(~F.col("l_partkey").isin(1, 2, 3)).count() == 0
    a = [tuple(r) for r in S.sample_rows(li.repartition(3), 20, seed=5).collect()]
    b = [tuple(r) for r in S.sample_rows(li.repartition(7), 20, seed=5).collect()]
    assert a == b and len(a) == 20


def test_cluster_conf_sizes_partitions():
    c = cluster_conf(100 * 2**40)
    assert int(c["spark.sql.shuffle.partitions"]) == 409601
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 << 20)


def test_replace_table_swaps_after_write(spark):
    path = scratch_path(spark, "swap")
    S.replace_table(spark.range(5), path)
    cur = spark.read.parquet(path)
    # the new version is computed from the table it replaces
    new = S.replace_table(cur.select((F.col("id") + 100).alias("id")), path)
    assert sorted(r.id for r in new.collect()) == [100, 101, 102, 103, 104]


def test_environment_tables_in_spark_sql(spark):
    import __spark_entry__ as E
    S.register_environment(spark, "prd", SF_SMALL, ["orders", "lineitem", "customer", "nation", "region"])
    sql = """SELECT o.o_orderkey FROM prd.orders o
             WHERE o.o_orderdate < DATE '2001-08-01' - INTERVAL 90 DAY
               AND NOT EXISTS (SELECT 1 FROM prd.lineitem l WHERE l.l_orderkey = o.o_orderkey)"""
    got = sorted(r.o_orderkey for r in spark.sql(sql).collect())
    want = sorted(r.o_orderkey for r in E.entry(spark).collect())
    assert got == want and len(got) > 0


def test_ordered_feed_written_as_text(spark):
    from retailops.plans.reports import feed
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, t string").repartition(3)
    path = scratch_path(spark, "feed")
    S.write_text(feed(df, [("k", 3, "num"), ("t", 2, "text")], order=["k"]), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sorted(lines) == ["001a ", "002b ", "003c "]
