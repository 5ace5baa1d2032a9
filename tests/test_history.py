"""History arrays: roll, prune, widen, load, level sums."""

from pyspark.sql import functions as F

from retailops.plans import history as H

N = H.WEEKS


def _hist(spark, rows):
    # rows: (key, {slot: value}, current)
    data = [(k, [float(s.get(i + 1, 0.0)) for i in range(N)], float(c)) for k, s, c in rows]
    return spark.createDataFrame(data, "k int, h array<double>, cur double")


def test_roll_shifts_and_prunes_before_shift(spark):
    df = _hist(spark, [(1, {1: 5.0}, 2.0), (2, {104: 1.0}, 0.0), (3, {}, 0.0)])
    r1 = {r.k: r for r in H.roll_history(df, {"h": ("cur", True)}).collect()}
    assert set(r1) == {1, 2}                      # all-zero row 3 pruned
    assert r1[1].h[0] == 2.0 and r1[1].h[1] == 5.0 and r1[1].cur == 0.0
    assert sum(r1[2].h) == 0.0                    # week-104 value fell off, row survives this roll
    r2 = H.roll_history(H.roll_history(df, {"h": ("cur", True)}), {"h": ("cur", True)})
    assert sorted(r.k for r in r2.collect()) == [1]   # ... and goes at the next


def test_multi_week_roll_equals_repeated_rolls(spark):
    df = _hist(spark, [(1, {1: 5.0, 90: 3.0}, 2.0), (2, {95: 1.0}, 0.0), (3, {100: 1.0}, 4.0), (4, {}, 0.0)])
    step = df
    for _ in range(12):
        step = H.roll_history(step, {"h": ("cur", True)})
    multi = H.roll_history(df, {"h": ("cur", True)}, weeks=12)
    assert sorted((r.k, tuple(r.h), r.cur) for r in step.collect()) == sorted((r.k, tuple(r.h), r.cur) for r in multi.collect())


def test_carry_current_roll(spark):
    df = _hist(spark, [(1, {1: 5.0}, 2.0)])
    r = H.roll_history(df, {"h": ("cur", False)}, weeks=3).first()
    assert r.h[:4] == [2.0, 2.0, 2.0, 5.0] and r.cur == 2.0


def test_widen_pads_with_zeros(spark):
    df = spark.createDataFrame([(1, [1.0] * 78)], "k int, h array<double>")
    r = H.widen_history(df, ["h"]).first()
    assert len(r.h) == 104 and sum(r.h) == 78.0 and r.h[78:] == [0.0] * 26


def test_load_history_replaces_slots_and_current(spark):
    hist = _hist(spark, [(1, {3: 7.0, 4: 1.0}, 0.0)]).withColumnRenamed("cur", "c")
    ch = spark.createDataFrame([(1, 0, 9.0), (1, 3, 2.0), (2, 1, 4.0), (2, 200, 1.0)], "k int, week_ago int, qty double")
    got = {r.k: r for r in H.load_history(hist, ch, ["k"], "week_ago", "qty", "h", current_col="c").collect()}
    assert got[1].c == 9.0 and got[1].h[2] == 2.0 and got[1].h[3] == 1.0
    assert got[2].h[0] == 4.0 and sum(got[2].h) == 4.0


def test_level_sum_equals_finer_sum(spark):
    df = _hist(spark, [(1, {1: 1.0, 2: 2.0}, 1.0), (2, {1: 3.0}, 0.0), (3, {104: 5.0}, 2.0)]) \
        .withColumn("grp", F.when(F.col("k") < 3, "a").otherwise("b"))
    lv = H.rollup_levels(df, [("grp", ["grp"]), ("all", [])], ["h"], ["cur"])
    a = {r.grp: r for r in lv["grp"].collect()}
    assert a["a"].h[0] == 4.0 and a["a"].h[1] == 2.0 and a["b"].h[103] == 5.0
    tot = lv["all"].first()
    assert sum(tot.h) == 11.0 and tot.cur == 3.0


def test_load_history_small_and_large_paths_agree(spark):
    hist = _hist(spark, [(k, {(k % 104) + 1: float(k)}, 0.0) for k in range(50)]).withColumnRenamed("cur", "c")
    odd = spark.createDataFrame([(100, None, None), (101, [7.0], 1.0), (41, [1.0], None)], "k int, h array<double>, c double")
    hist = hist.where("k <> 41").unionByName(odd.select(*hist.columns))
    ch = spark.createDataFrame([(k, k % 7, float(k) + 0.5) for k in range(40, 60)], "k int, week_ago int, qty double")
    a = H.load_history(hist, ch, ["k"], "week_ago", "qty", "h", current_col="c")
    b = H.load_history(hist, ch, ["k"], "week_ago", "qty", "h", current_col="c", split_bytes=0)
    key = lambda r: (r.k, tuple(r.h), r.c)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_multi_week_roll_property(spark):
    from hypothesis import given, settings, strategies as st

    row = st.tuples(st.dictionaries(st.integers(1, N), st.floats(-5, 5, allow_nan=False).map(lambda x: round(x)),
                                    max_size=4),
                    st.integers(-2, 2))

    @settings(max_examples=8, deadline=None)
    @given(rows=st.lists(row, min_size=1, max_size=6), weeks=st.integers(1, N))
    def check(rows, weeks):
        df = _hist(spark, [(i, s, c) for i, (s, c) in enumerate(rows)])
        step = df
        for _ in range(min(weeks, 3)):
            step = H.roll_history(step, {"h": ("cur", True)})
        multi = H.roll_history(df, {"h": ("cur", True)}, weeks=min(weeks, 3))
        key = lambda r: (r.k, tuple(r.h), r.cur)
        assert sorted(map(key, step.collect())) == sorted(map(key, multi.collect()))
    check()


def test_three_measures_roll_with_carry_reset_and_extra_prune_columns(spark):
    z = [0.0] * N
    data = [
        (1, z, 5.0, z, 2.0, z, 0.0, 0.0),          # on hand carries, sales resets
        (2, z, 0.0, z, 0.0, z, 0.0, 7.0),          # only on order: survives through prune_also
        (3, z, 0.0, z, 0.0, z, 0.0, 0.0),          # nothing at all: pruned
    ]
    df = spark.createDataFrame(data, "k int, oh array<double>, oh_cur double, sls array<double>, wtd double, "
                                     "reg array<double>, reg_wtd double, on_order double")
    out = H.roll_history(df, {"oh": ("oh_cur", False), "sls": ("wtd", True), "reg": ("reg_wtd", True)},
                         prune_also=["on_order"], weeks=2)
    got = {r.k: r for r in out.collect()}
    assert set(got) == {1, 2}
    assert got[1].oh[:3] == [5.0, 5.0, 0.0] and got[1].oh_cur == 5.0
    assert got[1].sls[:3] == [0.0, 2.0, 0.0] and got[1].wtd == 0.0
    assert got[2].on_order == 7.0


def test_roll_then_unroll_returns_the_history(spark):
    # unrolling k weeks = reading slots k+1.. of the rolled array; they equal slots 1..104-k before
    df = _hist(spark, [(1, {1: 1.0, 50: 2.0, 100: 3.0}, 4.0), (2, {2: 5.0}, 0.0)])
    k = 10
    before = {r.k: r for r in df.collect()}
    after = {r.k: r for r in H.roll_history(df, {"h": ("cur", True)}, weeks=k).collect()}
    for key, r in after.items():
        assert r.h[k:] == before[key].h[:N - k]
        assert r.h[k - 1] == before[key].cur


def test_level_totals_agree_on_driver_tables(spark):
    from conftest import SF_SMALL
    from retailops.workloads.history_q import d12
    out = d12(spark, SF_SMALL).groupBy("level").agg(F.round(F.sum("value"), 2).alias("t")).collect()
    totals = {r.level: r.t for r in out}
    assert set(totals) == {"supplier", "nation", "region"}
    assert totals["supplier"] == totals["nation"] == totals["region"]


def test_calendar_order_advance_slots_and_rejects(spark):
    import datetime as dt
    cal = H.order_weeks(H.month_calendar(spark, dt.date(2023, 11, 5), dt.date(2024, 2, 20)), ["yr", "mo"])
    rows = [(r.yr, r.mo, r.week_order) for r in cal.orderBy("week_order").collect()]
    assert rows == [(2023, 11, 1), (2023, 12, 2), (2024, 1, 3), (2024, 2, 4)]
    flagged = cal.withColumn("current_week", F.when((F.col("yr") == 2024) & (F.col("mo") == 1), "Y").otherwise("N"))
    assert [(r.yr, r.mo) for r in H.advance_week(flagged).where("current_week = 'Y'").collect()] == [(2024, 2)]
    ch = spark.createDataFrame([(1, 2023, 12, 5.0), (1, 2024, 2, 1.0), (2, 2022, 1, 9.0)], "k int, yr int, mo int, qty double")
    slots = {(r.k, r.week_ago) for r in H.weeks_ago(ch, cal, ["yr", "mo"], {"yr": 2024, "mo": 2}).collect()}
    assert slots == {(1, 2), (1, 0)}
    assert [(r.k, r.yr) for r in H.unknown_periods(ch, cal, ["yr", "mo"]).collect()] == [(2, 2022)]


def test_daily_calendar_fiscal_columns(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 2, 1),)], "d date")
    cal = {r.date: (r.fiscal_year, r.fiscal_period) for r in H.calendar_from_range(df, "d", fy_start_month=2).collect()}
    assert cal == {dt.date(2024, 1, 31): (2024, 12), dt.date(2024, 2, 1): (2025, 1)}


def test_history_day_equals_the_separate_steps(spark):
    import datetime as dt
    cal = H.order_weeks(H.month_calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 6, 30)), ["yr", "mo"])
    hist = _hist(spark, [(1, {1: 2.0, 3: 1.0}, 0.0), (2, {2: 4.0}, 1.0)]).withColumnRenamed("cur", "c") \
        .withColumn("g", F.lit("x"))
    ch = spark.createDataFrame([(1, 2024, 6, 9.0, "x"), (3, 2024, 5, 1.0, "x"), (4, 2023, 1, 5.0, "x")],
                               "k int, yr int, mo int, qty double, g string")
    out = H.history_day(hist, ch, cal, ["yr", "mo"], {"yr": 2024, "mo": 6}, ["k", "g"], "qty", "h", "c",
                        roll_weeks=1, levels=[("all", ["g"])])
    assert [r.k for r in out["rejects"].collect()] == [4]
    got = {r.k: (r.h[:4], r.c) for r in out["history"].collect()}
    assert got[1] == ([9.0, 2.0, 0.0, 1.0], 0.0)        # loaded current 9 rolled into slot 1
    assert got[3] == ([0.0, 1.0, 0.0, 0.0], 0.0)        # May value moved from slot 1 to 2
    lv = out["levels"]["all"].first()
    assert sum(lv.h) == 9.0 + 2.0 + 1.0 + 1.0 + 4.0 + 1.0 and lv.c == 0.0


def _slots(df):
    return sorted(map(tuple, df.collect()))


def test_load_slots_several_measures(spark):
    hist = spark.createDataFrame([(1, 0, 5.0, 1.0), (1, 2, 7.0, None), (2, 104, 3.0, 0.0)], "k int, slot int, a double, b double")
    ch = spark.createDataFrame([(1, 0, 6.0, None), (1, 1, None, 9.0), (3, 0, 1.0, 2.0), (3, 0, 1.0, None), (1, 105, 9.0, 9.0),
                                (1, -1, 9.0, 9.0), (1, None, 9.0, 9.0)], "k int, slot int, a double, b double")
    assert _slots(H.load_slots(hist, ch, ["k"], ["a", "b"])) == [
        (1, 0, 6.0, 1.0), (1, 1, 0.0, 9.0), (1, 2, 7.0, 0.0), (2, 104, 3.0, 0.0), (3, 0, 2.0, 2.0)]
    assert H.out_of_range(ch, "slot").count() == 3


def test_roll_slots_equals_array_roll(spark):
    import random
    rnd = random.Random(5)
    n = 6
    rows = [(k, {s: float(rnd.randint(1, 9)) for s in range(1, n + 1) if rnd.random() < 0.25},
             float(rnd.choice([0, 0, 4]))) for k in range(60)]
    arr = spark.createDataFrame([(k, [v.get(i, 0.0) for i in range(1, n + 1)], c) for k, v, c in rows],
                                "k int, h array<double>, cur double")
    long = spark.createDataFrame([(k, 0, c) for k, _, c in rows] + [(k, s, x) for k, v, _ in rows for s, x in v.items()],
                                 "k int, slot int, m double")
    for reset in (True, False):
        for weeks in (1, 3, n):
            a = {r.k: (list(r.h), r.cur) for r in H.roll_history(arr, {"h": ("cur", reset)}, weeks=weeks, n=n).collect()}
            b: dict = {}
            for r in H.roll_slots(long, ["k"], {"m": reset}, weeks=weeks, n=n).collect():
                b.setdefault(r.k, {})[r.slot] = r.m
            assert a.keys() == b.keys(), (reset, weeks)
            assert all(a[k] == ([b[k].get(i, 0.0) for i in range(1, n + 1)], b[k][0]) for k in a), (reset, weeks)


def test_roll_slots_week_104_survives_one_roll(spark):
    h = spark.createDataFrame([(1, 104, 2.0)], "k int, slot int, m double")
    once = H.roll_slots(h, ["k"], {"m": True})
    assert _slots(once) == [(1, 0, 0.0)]
    assert H.roll_slots(once, ["k"], {"m": True}).count() == 0


def test_fiscal_week_starts_with_the_fiscal_year(spark):
    import datetime as dt
    days = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 2, 1),), (dt.date(2024, 2, 4),), (dt.date(2025, 1, 31),)], "d date")
    cal = H.calendar_from_range(days, "d")
    got = {r.date.isoformat(): (r.fiscal_year, r.fiscal_week) for r in cal.join(days, cal.date == days.d).collect()}
    assert got == {"2024-01-31": (2024, 53), "2024-02-01": (2025, 1), "2024-02-04": (2025, 2), "2025-01-31": (2025, 53)}


def test_a_load_of_few_keys_equals_a_load_that_shuffles_all(spark):
    hist = spark.createDataFrame([(1, 0, 5.0, None), (1, 3, 2.0, 1.0), (2, 1, None, 7.0), (3, 99, 4.0, 4.0), (4, 200, 1.0, 1.0)],
                                 "k int, slot int, v double, w double")
    new = spark.createDataFrame([(1, 3, None, 9.0), (1, 4, 1.0, 1.0), (1, 4, 2.0, None), (5, 0, 1.0, None), (2, 300, 1.0, 1.0)],
                                hist.schema)
    few = H.load_slots(hist, new, ["k"], ["v", "w"])
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, H.load_slots(hist, new, ["k"], ["v", "w"], split_bytes=0).collect()))
    assert sorted(map(tuple, few.collect())) == [(1, 0, 5.0, 0.0), (1, 3, 2.0, 9.0), (1, 4, 3.0, 1.0), (2, 1, 0.0, 7.0),
                                                 (3, 99, 4.0, 4.0), (5, 0, 1.0, 0.0)]


def test_tasks_follow_the_rows_not_their_compressed_size(spark, monkeypatch):
    monkeypatch.setattr(H, "TASK_ROWS", 100)
    old = spark.range(5000).selectExpr("id % 1000 AS k", "int(id / 1000) + 2 AS slot", "double(id) AS v")
    new = spark.range(500).selectExpr("id AS k", "0 AS slot", "1.0D AS v")
    loaded = H.load_slots(old, new, ["k"], ["v"], split_bytes=0)
    assert loaded.rdd.getNumPartitions() >= 55 and loaded.count() == 5500
    wide = H.from_long(old, ["k"], "slot", "v", "h", n=10)
    assert wide.rdd.getNumPartitions() >= 50 and wide.count() == 1000
    assert wide.where("k = 7").first().h == [0.0, 7.0, 1007.0, 2007.0, 3007.0, 4007.0, 0.0, 0.0, 0.0, 0.0]
