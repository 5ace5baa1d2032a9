"""Nested sets, the history log, level tables kept by deltas, copies compared by digests, functions for SQL."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from retailops.functions import cols as C
from retailops.functions.sqlcode import register_functions, select_columns
from retailops.plans import audits, digests, nested
from retailops.plans import history as H
from retailops.plans.historylog import HistoryLog
from retailops.plans.levels import LevelTables
from retailops.session import scratch_path


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- nested sets

def plain_sets(rows):
    """(set, component) -> (quantity, depth) over all ways, and the pairs on a cycle."""
    edges = defaultdict(int)
    for a, b, q in rows:
        if a is not None and b is not None:
            edges[a, b] += q

    def reach(a, seen=None):
        seen = set() if seen is None else seen
        for x, y in edges:
            if x == a and y not in seen:
                seen.add(y)
                reach(y, seen)
        return seen

    bad = {(a, b) for a, b in edges if a in reach(b) or a == b}
    good = {e: q for e, q in edges.items() if e not in bad}
    out = {}

    def walk(root, node, qty, depth):
        for (a, b), q in good.items():
            if a == node:
                n, d = out.get((root, b), (0, depth))
                out[root, b] = (n + qty * q, min(d, depth))
                walk(root, b, qty * q, depth + 1)

    for root in {a for a, _ in good}:
        walk(root, root, 1, 1)
    return sorted(((a, b, n, d) for (a, b), (n, d) in out.items()), key=repr), bad


@pytest.mark.parametrize("seed", [1])
def test_nested_sets_with_cycles_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(a, rnd.randrange(a + 1, 25), rnd.randint(1, 3)) for a in range(18) for _ in range(rnd.randint(0, 2))]
    rows += [(30, 31, 1), (31, 32, 2), (32, 30, 1), (32, 33, 4), (33, 34, 1), (34, 33, 1), (40, 40, 1), (2, 30, 5),
             (None, 1, 1), (1, None, 1), rows[0]]
    sets = spark.createDataFrame(rows, "s long, c long, q long")
    want, bad = plain_sets(rows)
    found, rejects = nested.explode_nested(sets, "s", "c", "q")
    assert rows_of(found) == want
    assert rows_of(rejects) == sorted((r for r in rows if (r[0], r[1]) in bad), key=repr)
    assert (33, 34) in bad and (32, 33) not in bad  # a way from one cycle to another is on none
    some = nested.explode_nested(sets, "s", "c", "q", spark.createDataFrame([(2,), (99,)], "s long"))[0]
    assert rows_of(some) == [r for r in want if r[0] == 2]


def test_nested_sets_of_no_rows(spark):
    found, rejects = nested.explode_nested(spark.createDataFrame([], "s long, c long, q long"), "s", "c", "q")
    assert found.count() == rejects.count() == 0


# ---- history log

def test_a_roll_writes_no_history_file_and_equals_weekly_rolls(spark):
    rnd = random.Random(3)
    n, current = 6, 100
    rows = [(k, current - s, float(rnd.choice([0, 1, 2, -3]))) for k in range(30) for s in range(n + 1) if rnd.random() < 0.3]
    log = HistoryLog(spark, scratch_path(spark, "log"), ["k"], ["v"], n)
    changes = spark.createDataFrame(rows + [(1, 101, 1.0), (1, 93, 1.0), (2, None, 1.0)], "k long, period long, v double")
    log.create(changes, current)
    assert rows_of(log.load(changes)) == sorted([(1, 101, 1.0), (1, 93, 1.0), (2, None, 1.0)], key=repr)
    hist = spark.createDataFrame([(k, current - p, v) for k, p, v in rows], "k long, slot int, v double")
    for weeks in (1, 2, 1, 3):
        before = set(log.tables.files("log"))
        log.roll(weeks)
        assert set(log.tables.files("log")) <= before and len(log.tables.files("last")) >= 1
        hist = H.roll_slots(hist, ["k"], {"v": True}, weeks, n=n)
        hist = spark.createDataFrame(hist.collect(), hist.schema)
        assert rows_of(log.slots().where("v <> 0")) == rows_of(hist.where("v <> 0"))
        assert rows_of(log.alive()) == rows_of(hist.select("k").distinct())
    log.roll(1)
    assert log.tables.files("log") == [] and log.alive().count() == 0  # every period has left the window


def test_a_load_replaces_values_and_a_zero_takes_the_last_period_back(spark):
    log = HistoryLog(spark, scratch_path(spark, "log"), ["k"], ["v", "w"], 4)
    first = spark.createDataFrame([(1, 10, 5.0, None), (1, 8, 1.0, 2.0), (2, 7, 1.0, 1.0)], "k long, period long, v double, w double")
    log.create(first, 10)
    log.load(first)
    log.load(spark.createDataFrame([(1, 10, 0.0, None), (2, 7, None, 9.0), (3, 9, 1.0, 1.0), (3, 9, 2.0, None)], first.schema))
    assert rows_of(log.slots()) == [(1, 0, 0.0, 0.0), (1, 2, 1.0, 2.0), (2, 3, 1.0, 9.0), (3, 1, 3.0, 1.0)]
    assert dict(rows_of(log.tables.read("last"))) == {1: 8, 2: 7, 3: 9}


# ---- levels

def test_twenty_random_change_sets_equal_the_full_roll_up(spark):
    rnd = random.Random(5)
    levels = [("store", ["region", "store"]), ("region", ["region"])]
    row = lambda: (rnd.choice(["n", "s", None]), rnd.randrange(4), rnd.choice([None, rnd.randint(-9, 9) / 10]))
    schema = "region string, store int, amount double"
    now = [row() for _ in range(30)]
    t = LevelTables(spark, scratch_path(spark, "levels"), levels, ["amount"])
    t.create(spark.createDataFrame(now, schema))
    for i in range(20):
        gone = rnd.sample(now, min(len(now), rnd.randint(0, 6)))
        for g in gone:
            now.remove(g)
        new = [row() for _ in range(rnd.randint(0, 3))]
        now += new
        t.apply(spark.createDataFrame(gone, schema), spark.createDataFrame(new, schema))
        if i % 5 == 4:
            for name, keys in levels:
                want = defaultdict(lambda: [0, 0.0])
                for r in now:
                    w = want[r[0] if name == "region" else r[:2]]
                    w[0], w[1] = w[0] + 1, w[1] + (r[2] or 0)
                got = {tuple(r)[:-2] if name == "store" else r[0]: (r.n_rows, float(r.amount)) for r in t.read(name).collect()}
                assert got.keys() == want.keys()
                assert all(got[k][0] == n and got[k][1] == pytest.approx(s, abs=1e-9) for k, (n, s) in want.items())


def test_a_delta_leaves_the_files_of_other_groups(spark):
    t = LevelTables(spark, scratch_path(spark, "levels"), [("k", ["k"])], ["v"])
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    t.create(rows)
    t.tables.create("k", t.read("k"), "k", 8)
    before = set(t.tables.files("k"))
    t.apply(rows.where("k = 3"), rows.where("k = 4"))
    after = set(t.tables.files("k"))
    assert len(before) == 8 and len(before & after) == 7
    assert t.read("k").where("k = 3").count() == 0 and t.read("k").where("k = 4").first().n_rows == 2


# ---- digests

def test_only_differing_buckets_are_joined(spark):
    a = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit(None).cast("string").alias("s"))
    b = a.repartition(5).where("k <> 17").withColumn("v", F.when(F.col("k") == 4711, 99).otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(50000, 1, None)], a.schema))
    x, y = digests.only_differing(a, b, ["k"], ["v", "s"], buckets=256, fan=4)
    assert 2 <= x.count() <= 3 * 20000 / 256 * 1.5 and y.count() <= 3 * 20000 / 256 * 1.5
    assert rows_of(audits.reconcile(x, y, ["k"])) == rows_of(audits.reconcile(a, b, ["k"]))
    assert rows_of(audits.compare(x, y, ["k"], ["v"])) == rows_of(audits.compare(a, b, ["k"], ["v"])) != []
    same = digests.only_differing(a, a.repartition(3), ["k"], ["v", "s"])
    assert same[0].count() == same[1].count() == 0
    none = a.limit(0)
    assert digests.only_differing(a, none, ["k"])[0].count() == 20000
    assert digests.only_differing(none, none, ["k"])[0].count() == 0


def test_a_repeated_row_and_a_null_change_the_digest(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    for other in ([(1, "x"), (1, "x"), (2, None)], [(1, "x"), (2, "")], [(1, None), (2, "x")]):
        b = spark.createDataFrame(other, a.schema)
        assert digests.differing_buckets(digests.digest_tree(a, ["k"], ["v"]), digests.digest_tree(b, ["k"], ["v"])).count() > 0


def test_stored_digests_are_read_back(spark):
    path = scratch_path(spark, "tree")
    a = spark.range(100).withColumnRenamed("id", "k")
    tree = digests.digest_tree(a, ["k"], buckets=16, fan=4, path=path)
    assert rows_of(tree) == rows_of(spark.read.parquet(path)) and tree.where("level = 2").first().n_rows == 100


# ---- functions for SQL

def test_sql_functions_equal_the_column_functions(spark):
    register_functions(spark)
    df = spark.createDataFrame([("4006381333931",), ("0400638133393",), ("12",), (None,)], "c string")
    df.createOrReplaceTempView("codes_now")
    got = spark.sql("SELECT item_check_digit(c), item_short_code(c), item_long_code(c) FROM codes_now WHERE length(c) = 13 OR c IS NULL")
    want = df.where("length(c) = 13 OR c IS NULL").select(C.check_digit("c"), C.to_short_code("c"), C.to_long_code("c"))
    assert rows_of(got) == rows_of(want)
    assert spark.sql("SELECT nth_weekday(2024, 11, 5, 4)").first()[0].isoformat() == "2024-11-28"
    assert spark.sql("SELECT status_name(25), status_name(7), may_release(30, NULL), may_release(30, 2)").first()[:] == (
        "DISCREPANCY", None, True, False)


def test_a_column_list_built_at_run_time(spark):
    spark.createDataFrame([(1, 2, 3)], "`a b` int, `a_c` int, `x``y` int").createOrReplaceTempView("odd_names")
    assert select_columns(spark, "odd_names", "a%").columns == ["a b", "a_c"]
    assert rows_of(select_columns(spark, "odd_names", "x_y", "{c} + 1")) == [(4,)]
    with pytest.raises(ValueError):
        select_columns(spark, "odd_names", "z%")


def test_rows_of_differing_buckets_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(H, "TASK_ROWS", 100)
    a = spark.range(3000).selectExpr("id AS k")
    b = a.where("k % 7 <> 0")
    x, y = digests.only_differing(a, b, ["k"], buckets=16, fan=4)
    assert x.rdd.getNumPartitions() == y.rdd.getNumPartitions() >= 55
    assert (x.count(), y.count()) == (a.count(), b.count())
