"""Streamed change ingest equals the batch apply of the settled rows."""

import datetime as dt

from pyspark.sql import functions as F

from retailops.plans.changes import apply_changes
from retailops.sources.tables import read_table
from retailops.workloads.streaming_q import SETTLE_SECONDS, _to_changes, run_stream

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    state, pending = run_stream(spark, SF_SMALL, n_files=4)
    ev = read_table(spark, SF_SMALL, "events")
    cust = read_table(spark, SF_SMALL, "customer")
    newest = ev.agg(F.max("ts")).first()[0]
    cutoff = newest - dt.timedelta(seconds=SETTLE_SECONDS)
    ch = _to_changes(ev)
    target = cust.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"),
                         F.lit("none").alias("last_type"))
    cut = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
    batch = apply_changes(target, ch.where(F.col("ts") <= cut), ["user_id"])
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, batch.collect()))
    # nothing lost: every change is either applied (<= cutoff) or still pending
    assert pending.count() == ch.where(F.col("ts") > cut).count()


def test_continuous_trigger_and_read_state(spark):
    from retailops.session import scratch_path
    from retailops.streaming.ingest import ingest_changes, read_state, write_change_files
    ev = read_table(spark, SF_SMALL, "events")
    cust = read_table(spark, SF_SMALL, "customer")
    src, work = scratch_path(spark, "feed"), scratch_path(spark, "ingest")
    write_change_files(ev, src, "ts", 3)
    target = cust.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"),
                         F.lit("none").alias("last_type"))
    q = ingest_changes(spark, src, ev.schema, target, ["user_id"], work, ts_col="ts", settle_seconds=10,
                       to_changes=_to_changes, processing_time="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    state, pending = read_state(spark, work, ["user_id"])
    batch_state, _ = run_stream(spark, SF_SMALL, n_files=3)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, batch_state.collect()))


def test_deferred_changes_wait_in_pending(spark):
    ev = read_table(spark, SF_SMALL, "events")
    orders = read_table(spark, SF_SMALL, "orders")
    busy = orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("user_id")).distinct()
    state, pending = run_stream(spark, SF_SMALL, busy=busy, n_files=3)
    newest = ev.agg(F.max("ts")).first()[0]
    cut = F.lit((newest - dt.timedelta(seconds=SETTLE_SECONDS)).isoformat(sep=" ")).cast("timestamp_ntz")
    busy_ev = ev.join(busy, "user_id", "left_semi")
    young_free = ev.join(busy, "user_id", "left_anti").where(F.col("ts") > cut)
    assert pending.count() == busy_ev.count() + young_free.count()
    # no busy user's change reached the state: their rows keep the starting values
    touched = state.join(busy, "user_id", "left_semi").where(F.col("last_type") != "none").count()
    assert touched == 0


def _feed(spark, rows, path):
    schema = "k int, op int, seq long, ts timestamp_ntz, v double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).schema


def test_late_change_after_a_delete_is_ignored_and_old_folders_go(spark):
    from retailops.session import scratch_path
    from retailops.streaming.ingest import _batches, ingest_changes, read_rejects, read_state
    src, work = scratch_path(spark, "feed"), scratch_path(spark, "ingest")
    target = spark.createDataFrame([(1, 10.0), (2, 20.0), (9, 90.0)], "k int, v double")
    day = lambda h: dt.datetime(2024, 1, 1, h)
    files = [[(1, 3, 5, day(1), None), (2, 2, 6, day(1), 21.0), (9, 2, 2, None, 1.0)],  # delete 1; a row without a time
             [(1, 2, 3, day(2), 99.0), (2, 2, 4, day(2), 98.0)],                        # both late
             [(3, 1, 9, day(3), 30.0)], [(1, 1, 12, day(4), 11.0)], [(2, 3, 13, day(5), None)]]
    for f in files:
        schema = _feed(spark, f, src)
        ingest_changes_once(spark, src, schema, target, work) if f is files[-1] else None
    state, pending = read_state(spark, work, ["k"])
    assert sorted(map(tuple, state.collect())) == [(1, 11.0), (3, 30.0), (9, 90.0)]
    assert pending.count() == 0
    assert [(r.k, r.seq) for r in read_rejects(spark, work).collect()] == [(9, 2)]
    assert len(_batches(spark, f"{work}/log")) <= 4 and len(_batches(spark, f"{work}/pending")) <= 2


def ingest_changes_once(spark, src, schema, target, work):
    from retailops.streaming.ingest import ingest_changes
    return ingest_changes(spark, src, schema, target, ["k"], work, ts_col="ts", settle_seconds=0, compact_every=2)


def _folders(spark):
    import os
    from retailops.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {d for d in os.listdir(root) if d.split("-")[0] in ("changes", "ingest")}


def test_a_row_from_the_future_settles_no_other_and_batches_leave_no_scratch(spark):
    from retailops.session import scratch_path
    from retailops.streaming.ingest import ingest_changes
    src, work = scratch_path(spark, "feed"), scratch_path(spark, "work")
    target = spark.createDataFrame([(1, 10.0)], "k int, v double")
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    _feed(spark, [(1, 2, 1, at(0), 1.0), (2, 1, 2, at(1), 2.0)], src)
    schema = _feed(spark, [(3, 1, 3, dt.datetime(2099, 1, 1), 3.0)], src)
    before = _folders(spark)
    run = lambda clock: ingest_changes(spark, src, schema, target, ["k"], work, ts_col="ts", settle_seconds=10, clock=clock)
    state, pending = run(None)
    assert sorted(map(tuple, state.collect())) == [(1, 10.0)] and pending.count() == 3
    assert _folders(spark) == before
    # a restart: a newer row settles the two; the far one still waits
    _feed(spark, [(4, 1, 4, at(30), 4.0)], src)
    state, pending = run(None)
    assert sorted(map(tuple, state.collect())) == [(1, 1.0), (2, 2.0)]
    assert sorted(r.k for r in pending.collect()) == [3, 4]
    # its time comes
    _feed(spark, [(5, 1, 5, dt.datetime(2099, 1, 2), 5.0)], src)
    state, pending = run(lambda: dt.datetime(2100, 1, 1))
    assert sorted(map(tuple, state.collect())) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]
    assert [r.k for r in pending.collect()] == [5] and _folders(spark) == before


def test_scratch_of_a_failed_block_goes_too(spark):
    import os
    import pytest
    from retailops.session import scratch_scope, store
    made = []
    with pytest.raises(ValueError):
        with scratch_scope(spark):
            with scratch_scope(spark):
                inner = store(spark.range(3)).inputFiles()
            made = store(spark.range(3)).inputFiles()
            assert not os.path.exists(inner[0].removeprefix("file://")) and os.path.exists(made[0].removeprefix("file://"))
            raise ValueError
    assert not os.path.exists(made[0].removeprefix("file://"))


def test_a_slice_of_many_files_is_one_batch(spark):
    import datetime as dt

    from retailops.session import scratch_path
    from retailops.streaming.ingest import _batches, ingest_changes, write_change_files
    rows = [(i, 1, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, op int, seq long, ts timestamp_ntz, v double").repartition(4)
    src, work = scratch_path(spark, "slices"), scratch_path(spark, "slices-state")
    n = write_change_files(df, src, "ts", 2)
    assert n == 4
    target = spark.createDataFrame([], "k long, v double")
    state, pending = ingest_changes(spark, src, df.schema, target, ["k"], work, "ts", 10, max_files_per_trigger=n)
    assert state.count() == 39 and pending.count() == 1 and len(_batches(spark, f"{work}/log")) == 2
