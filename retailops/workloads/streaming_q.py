"""Streaming queries (J1, J2): the events table replayed as a change feed.

Events are split into time-ordered slices, streamed with ``availableNow`` about a slice
per micro-batch, however many files it has, and applied to the user state as in ``i25`` (signup = insert,
view/click/purchase = update, error = delete). The twins are the batch apply of the rows up to the cut-off, and the rows that
stay pending.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming.ingest import ingest_changes, read_state, write_change_files
from ..streaming.timers import ingest_timed, read_waiting
from .changes_q import _CH_SQL, _OP_SQL, _op
from .registry import query, tables

SETTLE_SECONDS = 10  # line changes settle for 10 s before they are taken (notes: 4 s)


def _to_changes(raw):
    return raw.select("user_id", _op().alias("op"), F.col("event_id").alias("seq"), "ts",
                      F.col("value").alias("balance"), F.col("event_type").alias("last_type"))


def run_stream(spark, d, busy=None, n_files=6):
    cust, ev = tables(spark, d, "customer", "events")
    src = scratch_path(spark, "events-feed")
    per_slice = write_change_files(ev, src, "ts", n_files)
    target = cust.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"),
                         F.lit("none").alias("last_type"))
    return ingest_changes(spark, src, ev.schema, target, ["user_id"], scratch_path(spark, "events-ingest"),
                          ts_col="ts", settle_seconds=SETTLE_SECONDS, busy=busy, to_changes=_to_changes,
                          max_files_per_trigger=per_slice)


_CUT_SQL = f"cut AS (SELECT max(ts) - INTERVAL {SETTLE_SECONDS} SECOND AS c FROM events)"


_J1_SQL = f"""
WITH {_CUT_SQL},
{_CH_SQL.replace("FROM events)", "FROM events, cut WHERE ts <= cut.c)", 1)}
SELECT user_id, balance, last_type FROM m WHERE last_del IS NULL OR NOT last_del"""


@query("j1_stream_change_ingest", _J1_SQL)
def j1(spark, d):
    state, _ = run_stream(spark, d)
    return state


_J2_SQL = f"""
WITH {_CUT_SQL},
busy AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
SELECT user_id, {_OP_SQL} AS op, event_id AS seq, ts, value AS balance, event_type AS last_type FROM events, cut
WHERE ts > cut.c OR user_id IN (SELECT o_custkey FROM busy)"""


def _busy_users(spark, d):
    (orders,) = tables(spark, d, "orders")
    return (orders.where((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"))
                  .select(F.col("o_custkey").alias("user_id")))


@query("j2_stream_deferred_changes", _J2_SQL)
def j2(spark, d):
    _, pending = run_stream(spark, d, busy=_busy_users(spark, d))
    return pending


def run_timed(spark, d, busy=None, n_files=3):
    """The same feed with its waiting changes in the state store; returns the work folder and the changes' schema."""
    cust, ev = tables(spark, d, "customer", "events")
    src, work = scratch_path(spark, "events-feed"), scratch_path(spark, "events-timed")
    write_change_files(ev, src, "ts", n_files)
    target = cust.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"),
                         F.lit("none").alias("last_type"))
    feed = _to_changes(spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").parquet(src))
    schema = feed.schema
    if busy is not None:
        feed = feed.join(busy.distinct().withColumn("in_progress", F.lit(True)), "user_id", "left")
    ingest_timed(feed, target, ["user_id"], work, "ts", SETTLE_SECONDS, busy_col="in_progress" if busy is not None else None)
    return work, schema


@query("j1b_timed_change_ingest", _J1_SQL)
def j1b(spark, d):
    work, _ = run_timed(spark, d)
    return read_state(spark, work, ["user_id"])[0]


@query("j2b_timed_deferred_changes", _J2_SQL)
def j2b(spark, d):
    work, schema = run_timed(spark, d, busy=_busy_users(spark, d))
    return read_waiting(spark, work, schema)
