"""Micro-batch change ingest (J1) with deferred-change state.

The reference polls inbound queue tables, takes rows older than "now minus a settle
time", applies them, deletes what it took and checks the counts. Here the queue is
a Structured Streaming file source and each micro-batch runs in ``foreachBatch``:

* rows whose time is at least ``settle_seconds`` older than the newest row seen
  are applied (``apply_changes``); younger rows go to a *pending* table and are
  offered again with the next batch, so nothing is lost to the cut-off; rows without a
  time go to a *rejects* table. A row dated after the batch's own time waits until that time has come, and
  settles no other row;
* with ``busy`` keys (lines in progress), changes for those keys are deferred to
  the pending table too (J2) and retried every batch;
* the state is a base table and a log: a batch writes only the keys it touched, with the last
  sequence applied to each, deleted keys included, so a late change cannot roll a key back or
  revive one. Every ``compact_every`` batches the log is folded into a new base;
* what a batch stores for itself is deleted when it ends, also when it fails;
* each batch writes under its own batch id and reads only what stands below it, so a batch
  repeated after a failure overwrites its own output with the same result. Folders that no batch can
  read again are deleted.

State lives in the folder given by the caller (a shared file system on a cluster).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import ts_literal
from ..plans.changes import apply_changes, split_deferred
from ..session import scratch_scope, store


def _batches(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        val = name.split("=", 1)[1] if name.startswith("batch=") else ""
        if st.isDirectory() and val.lstrip("-").isdigit():  # skips batch=N.tmp staging folders
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{st.getPath().toString()}/_SUCCESS")):
                out.append(int(val))
    return sorted(out)


def _latest(spark: SparkSession, root: str, below: int | None = None) -> str | None:
    ids = [b for b in _batches(spark, root) if below is None or b < below]
    return f"{root}/batch={ids[-1]}" if ids else None


def _drop_below(spark: SparkSession, root: str, batch: int) -> None:
    """Delete the folders of batches before ``batch``."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for b in _batches(spark, root):
        if b < batch:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/batch={b}"), True)


def _keyed_state(spark: SparkSession, work_dir: str, keys: Sequence[str], below: int | None = None) -> DataFrame:
    """All keys ever seen with their row, ``_last_seq`` and ``_deleted``, as of the batches before ``below``."""
    bases = [b for b in _batches(spark, f"{work_dir}/base") if below is None or b < below]
    base = spark.read.parquet(f"{work_dir}/base/batch={bases[-1]}")
    logs = [b for b in _batches(spark, f"{work_dir}/log") if b > bases[-1] and (below is None or b < below)]
    if not logs:
        return base
    rows = None
    for b in logs:
        r = spark.read.schema(base.schema).parquet(f"{work_dir}/log/batch={b}").withColumn("_batch", F.lit(b))
        rows = r if rows is None else rows.unionByName(r)
    rest = [c for c in base.columns if c not in keys]
    new = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*base.columns))


def read_state(spark: SparkSession, work_dir: str, keys: Sequence[str], schema=None) -> tuple[DataFrame, DataFrame | None]:
    """The latest committed ``(state, pending)`` of an ingest folder."""
    state = _keyed_state(spark, work_dir, list(keys)).where(~F.col("_deleted")).drop("_last_seq", "_deleted")
    pend = _latest(spark, f"{work_dir}/pending")
    if pend:
        return state, spark.read.parquet(pend)
    return state, (spark.createDataFrame([], schema) if schema is not None else None)


def read_rejects(spark: SparkSession, work_dir: str) -> DataFrame | None:
    """All changes without a time, of every batch; None before the first batch."""
    ids = _batches(spark, f"{work_dir}/rejects")
    return spark.read.parquet(*[f"{work_dir}/rejects/batch={b}" for b in ids]) if ids else None


def open_state(target: DataFrame, work_dir: str) -> None:
    """Write ``target`` as the first base table of an ingest folder."""
    (target.withColumn("_last_seq", F.lit(None).cast("long")).withColumn("_deleted", F.lit(False))
           .write.mode("overwrite").parquet(f"{work_dir}/base/batch=-1"))


def apply_batch(ready: DataFrame, work_dir: str, keys: list[str], columns: Sequence[str], batch_id: int, op_col: str,
                seq_col: str, mode: str, compact_every: int) -> DataFrame:
    """Apply the changes of one batch to the state of an ingest folder; returns the stored (keys, ``_n``) taken."""
    spark = ready.sparkSession
    ready = store(ready, "ingest-ready")
    touched = store(ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                             F.max(F.col(seq_col).cast("long")).alias("_max_seq")), "ingest-touched")
    # the state of the touched keys only: the base is streamed past them, not shuffled, when they are few
    state = store(_keyed_state(spark, work_dir, keys, below=batch_id).join(
        touched.select(*keys), keys, "left_semi"), "ingest-state")
    seen = state.select(*keys, F.col("_last_seq").alias("_seen"))
    fresh = (ready.join(seen, keys, "left")
                  .where(F.col("_seen").isNull() | (F.col(seq_col) > F.col("_seen"))).drop("_seen"))
    live = state.where(~F.col("_deleted")).select(*columns)
    after = apply_changes(live, fresh, keys, op_col, seq_col, mode).withColumn("_here", F.lit(True))
    log = (touched.join(seen, keys, "left").join(after, keys, "left")
           .withColumn("_last_seq", F.greatest("_max_seq", "_seen"))
           .withColumn("_deleted", F.col("_here").isNull()))
    log.select(*columns, "_last_seq", "_deleted").write.mode("overwrite").parquet(f"{work_dir}/log/batch={batch_id}")
    if (batch_id + 1) % compact_every == 0:
        bases = _batches(spark, f"{work_dir}/base")
        _keyed_state(spark, work_dir, keys, below=batch_id + 1).write.mode("overwrite").parquet(
            f"{work_dir}/base/batch={batch_id}")
        keep = max([b for b in bases if b < batch_id], default=-1)  # a repeat of this batch still reads it
        _drop_below(spark, f"{work_dir}/base", keep)
        _drop_below(spark, f"{work_dir}/log", keep)
    return touched


def ingest_changes(spark: SparkSession, source_dir: str, schema, target: DataFrame, keys: Sequence[str],
                   work_dir: str, ts_col: str, settle_seconds: float, op_col: str = "op",
                   seq_col: str = "seq", busy: DataFrame | None = None, max_files_per_trigger: int = 1,
                   mode: str = "last", to_changes=None, processing_time: str | None = None,
                   verify_counts: bool = True, compact_every: int = 16,
                   clock: Callable[[], _dt.datetime] | None = None):
    """Stream the change files under ``source_dir`` into ``target``.

    ``to_changes`` maps a raw micro-batch to change rows (keys, op, seq, ts and the
    target's value columns); by default the raw rows are used as they are.

    By default the stream processes what is there and stops (``availableNow``) and
    the final ``(state, pending)`` DataFrames are returned. With
    ``processing_time`` (e.g. ``"10 seconds"``) the query keeps running and the
    ``StreamingQuery`` is returned; ``read_state(spark, work_dir)`` reads the
    latest committed state at any time.

    ``verify_counts`` compares in every batch the queue with what was taken from it: the rows
    that came in must equal those counted in the stored, reduced change set plus those written
    to the pending and the rejects table (the reference's insert-equals-delete check); the batch
    fails otherwise.

    ``clock`` gives the time of a batch (UTC without a zone, by default the driver's): the newest row counts only up to it.
    """
    keys = list(keys)
    pending_root, rejects_root = f"{work_dir}/pending", f"{work_dir}/rejects"
    open_state(target, work_dir)
    busy_keys = busy.select(*keys).distinct() if busy is not None else None
    ntz = isinstance(schema[ts_col].dataType, T.TimestampNTZType)

    def process(batch_df: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            take(batch_df, batch_id)

    def take(batch_df: DataFrame, batch_id: int) -> None:
        incoming = to_changes(batch_df) if to_changes else batch_df
        prev_pending = _latest(spark, pending_root, below=batch_id)
        if prev_pending:
            incoming = incoming.unionByName(spark.read.parquet(prev_pending).select(*incoming.columns))
        now = ts_literal(clock() if clock else _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), ntz=ntz)
        n_in, newest = incoming.agg(F.count(F.lit(1)), F.max(F.when(F.col(ts_col) <= now, F.col(ts_col)))).first()
        if not n_in:
            return
        incoming.where(F.col(ts_col).isNull()).write.mode("overwrite").parquet(f"{rejects_root}/batch={batch_id}")
        cut = ts_literal(newest - _dt.timedelta(seconds=settle_seconds), ntz=ntz) if newest else F.lit(None)
        settled = F.coalesce(F.col(ts_col) <= cut, F.lit(False))  # no row up to now: nothing has settled
        ready = incoming.where(settled)
        young = incoming.where(F.col(ts_col).isNotNull() & ~settled)
        if busy_keys is not None:
            ready, deferred = split_deferred(ready, busy_keys.withColumn("status_code", F.lit(20)), keys)
            young = young.unionByName(deferred)
        touched = apply_batch(ready, work_dir, keys, target.columns, batch_id, op_col, seq_col, mode, compact_every)
        # the pending table of this batch becomes visible only after the state is written
        young.write.mode("overwrite").parquet(f"{pending_root}/batch={batch_id}")
        _drop_below(spark, pending_root, batch_id - 1)
        if verify_counts:
            taken = touched.agg(F.sum("_n")).first()[0] or 0
            left = spark.read.parquet(f"{pending_root}/batch={batch_id}").count()
            bad = spark.read.parquet(f"{rejects_root}/batch={batch_id}").count()
            if n_in != taken + left + bad:
                raise RuntimeError(f"batch {batch_id}: {n_in} rows in, {taken} taken + {left} pending + {bad} rejected")

    w = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .option("recursiveFileLookup", "true").parquet(source_dir)
              .writeStream.foreachBatch(process).option("checkpointLocation", f"{work_dir}/_checkpoint"))
    if processing_time:
        return w.trigger(processingTime=processing_time).start()
    w.trigger(availableNow=True).start().awaitTermination()
    return read_state(spark, work_dir, keys, target.schema)


def write_change_files(df: DataFrame, dest: str, ts_col: str, n_files: int) -> int:
    """Split a change table into ``n_files`` time slices written one after another
    (so file modification order follows time, as an upstream feed would deliver).

    A slice has as many files as its tasks wrote; returns the most files of a slice, by which a stream takes about a slice
    at a time (``max_files_per_trigger``). Rows without a time go with the first slice."""
    bounds = df.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        df.write.mode("overwrite").parquet(f"{dest}/slice=0000")
        return _most_files(df.sparkSession, dest)
    ntz = isinstance(df.schema[ts_col].dataType, T.TimestampNTZType)
    step = (hi - lo) / n_files
    for i in range(n_files):
        cond = F.col(ts_col) >= ts_literal(lo + step * i, ntz)
        if i < n_files - 1:
            cond = cond & (F.col(ts_col) < ts_literal(lo + step * (i + 1), ntz))
        if i == 0:
            cond = cond | F.col(ts_col).isNull()
        df.where(cond).write.mode("overwrite").parquet(f"{dest}/slice={i:04d}")
    return _most_files(df.sparkSession, dest)


def _most_files(spark: SparkSession, root: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(s.getPath())) for s in fs.listStatus(path))
