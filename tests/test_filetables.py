"""Tables changed file by file: which files stay, what a failed or late commit leaves, the purge graph."""

import random

import pytest
from pyspark.sql import functions as F

from retailops.plans import changes as X
from retailops.session import scratch_path
from retailops.sources.filetables import CommitConflict, FileTables


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ten_files(spark, name="t", n=1000):
    t = FileTables(spark, scratch_path(spark, "files"))
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"), F.col("id").cast("string").alias("b"))
    t.create(name, df.repartitionByRange(10, "k"))
    return t


def test_an_update_of_three_keys_leaves_all_other_files_as_they_are(spark):
    t = ten_files(spark)
    before = set(t.files("t"))
    assert len(before) == 10
    t.update_where("t", F.col("k").isin(5, 7, 998), {"a": F.lit(-1)})
    after = set(t.files("t"))
    assert len(before & after) == 8  # the keys stand in two files
    assert rows_of(t.read("t")) == sorted(((k, -1 if k in (5, 7, 998) else 2 * k, str(k)) for k in range(1000)), key=repr)
    assert rows_of(t.read("t", 1)) == sorted(((k, 2 * k, str(k)) for k in range(1000)), key=repr)  # the version before


def test_files_without_a_changed_key_are_not_read(spark):
    t = FileTables(spark, scratch_path(spark, "files"))
    t.create("t", spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")), "k", 10)
    changes = spark.createDataFrame([(3, 2, 1, "new"), (4, 3, 1, None)], "k long, op int, seq long, v string")
    _, state = t.state()
    seen = []
    t._open = lambda entry, files, old=t._open: (seen.extend(files), old(entry, files))[1]
    n = t.manifest("t").where("lo <= 4 and hi >= 3").count()
    before = set(t.files("t"))
    t.apply_changes("t", changes, "k")
    assert len(seen) == len(before - set(t.files("t"))) <= n < len(before)
    assert dict(rows_of(t.read("t").where("k < 6"))) == {0: "x", 1: "x", 2: "x", 3: "new", 5: "x"}


def test_random_change_sets_equal_the_change_of_the_whole_table(spark):
    rnd = random.Random(11)
    t = FileTables(spark, scratch_path(spark, "files"))
    whole = spark.createDataFrame([(k, "v0") for k in range(40)] + [(None, "none")], "k long, v string")
    t.create("t", whole, "k", 6)
    for i in range(4):
        ch = spark.createDataFrame([(rnd.randrange(60), rnd.choice([1, 2, 3]), j, f"v{i}-{j}") for j in range(8)],
                                   "k long, op int, seq long, v string")
        whole = X.apply_changes(whole, ch, "k")
        t.apply_changes("t", ch, "k")
        assert rows_of(t.read("t")) == rows_of(whole)
    src = spark.createDataFrame([(1, "m"), (100, "m")], "k long, v string")
    t.merge_upsert("t", src, "k")
    t.append("t", spark.createDataFrame([(7, "again")], "k long, v string"))
    t.delete_where("t", F.col("v") == "v0")
    want = X.delete_where(X.merge_upsert(whole, src, "k").unionByName(
        spark.createDataFrame([(7, "again")], "k long, v string")), F.col("v") == "v0")
    assert rows_of(t.read("t")) == rows_of(want)


def test_a_late_writer_fails_and_changes_nothing(spark):
    t = ten_files(spark)
    base, _ = t.state()
    t.update_where("t", F.col("k") == 1, {"a": F.lit(0)})
    with pytest.raises(CommitConflict):
        t.change({"t": (F.col("k") == 2, (), lambda rows: rows.limit(0))}, base)
    with pytest.raises(CommitConflict):
        t.commit(base, t.state()[1])  # as a writer that read the version before
    assert t.read("t").count() == 1000 and t.read("t").where("a = 0").count() == 2


def test_vacuum_deletes_only_what_no_kept_version_lists(spark):
    t = ten_files(spark)
    for k in (1, 500, 999):
        t.delete_where("t", F.col("k") == k)
    now, before = rows_of(t.read("t")), rows_of(t.read("t", 3))
    assert t.vacuum(keep=2) == 2 + 2  # two data files and two manifests
    assert rows_of(t.read("t")) == now and rows_of(t.read("t", 3)) == before
    with pytest.raises(ValueError):
        t.read("t", 1)


def test_empty_tables_and_changes_that_touch_nothing(spark):
    t = FileTables(spark, scratch_path(spark, "files"))
    t.create("t", spark.createDataFrame([], "k long, v string"), "k")
    assert t.read("t").count() == 0
    t.append("t", spark.createDataFrame([(1, "a")], "k long, v string"))
    t.update_where("t", F.col("k") == 9, {"v": F.lit("z")})
    assert rows_of(t.read("t")) == [(1, "a")]
    t.delete_where("t", F.lit(True))
    assert t.read("t").count() == 0 and t.read("t").columns == ["k", "v"]


# ---- update_where, sync_set

def test_an_update_reads_the_old_row(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "a int, b int")
    assert rows_of(X.update_where(df, F.col("a") == 1, {"a": F.lit(9), "b": F.lit(0)})) == [(2, 6), (9, 0), (None, 7)]
    assert rows_of(X.update_where(df, F.col("a") > 0, {"a": F.col("b"), "b": F.col("a")})) == [(5, 1), (6, 2), (None, 7)]


def test_sync_set_with_repeated_and_null_keys(spark):
    t = spark.createDataFrame([(None, "old", "mine"), (1, "x", "kept")], "k int, a string, note string")
    s = spark.createDataFrame([(None, "new"), (1, "y")], "k int, a string")
    assert rows_of(X.sync_set(t, s, "k", ["a"], {"note": "d"})) == [(1, "y", "kept"), (None, "new", "mine")]
    with pytest.raises(Exception, match="sync source"):
        X.sync_set(t, s.unionByName(s), "k", ["a"], {"note": "d"}).collect()


# ---- purge graph

def graph(spark):
    """Work list, results header with its details, formats by allocation; allocation 0 stands for none yet."""
    t = FileTables(spark, scratch_path(spark, "graph"))
    t.create("worklist", spark.createDataFrame([(1, 10), (2, 0), (3, 30), (4, 0), (5, None)], "wl_key long, alloc long"))
    t.create("header", spark.createDataFrame([(10, 1), (0, 2), (30, 3), (10, 4)], "alloc long, h long"))
    t.create("detail", spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (9, "f")], "h long, d string"))
    t.create("plan", spark.createDataFrame([(10, "p"), (30, "q"), (77, "r"), (None, "s")], "alloc long, p string"))
    return t



def links():
    return [("worklist", "header", [("alloc", "alloc")], F.col("alloc") > 0), ("header", "detail", [("h", "h")], None)]


def test_purge_by_two_keys_over_two_levels(spark):
    t = graph(spark)
    start = {"worklist": spark.createDataFrame([(1,), (2,), (5,), (None,)], "wl_key long")}
    gone = X.purge_graph(t, start, links(), [("worklist", "plan", [("alloc", "alloc")])])
    assert rows_of(t.read("worklist")) == [(3, 30), (4, 0)]
    assert rows_of(t.read("header")) == [(0, 2), (30, 3)]  # allocation 0 takes nothing along
    assert rows_of(t.read("detail")) == [(2, "c"), (3, "d"), (9, "f")]
    assert rows_of(t.read("plan")) == [(30, "q"), (None, "s")]  # 77 had no parent before
    assert len(t.versions()) == 5 and rows_of(gone["detail"][0][0]) == [(1,), (4,)]


def test_a_failure_in_the_third_table_changes_none(spark):
    t = graph(spark)
    before = {n: rows_of(t.read(n)) for n in ("worklist", "header", "detail", "plan")}
    write, calls = t._write, []

    def fails(name, entry, df):
        calls.append(name)
        if len(calls) == 3:
            raise IOError("disk full")
        return write(name, entry, df)

    t._write = fails
    with pytest.raises(IOError):
        X.purge_graph(t, {"worklist": spark.createDataFrame([(1,)], "wl_key long")}, links(),
                      [("worklist", "plan", [("alloc", "alloc")])])
    assert len(calls) == 3
    assert {n: rows_of(t.read(n)) for n in before} == before and len(t.versions()) == 4


def test_links_in_a_circle_are_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        X.purge_graph(graph(spark), {}, links() + [("detail", "worklist", [("h", "wl_key")], None)])


def test_file_names_are_cut_for_files_not_for_rows(spark):
    t = FileTables(spark, scratch_path(spark, "names"))
    t.create("t", spark.range(0, 100, 1, 3), cluster="id", files=3)
    rows = t._write("t", t.state()[1]["t"], spark.range(0, 10, 1, 2))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Project" in line and "regexp" in line]
    assert all(r.path.startswith("t/data/") for r in rows.collect())
    assert len(t.touched("t", t.state()[1]["t"], t.manifest("t"), F.col("id") == 5)) == 1
