"""Changes that wait in Spark's state store until a timer releases them.

The second way of keeping deferred changes, beside the pending tables of ``ingest``: each key's
waiting changes are a list in the state store, and a timer for the earliest of them releases what has settled when
the watermark, the newest time seen less the settle time, has reached it. A micro-batch writes the changed keys of
the state store only; changes that wait are not read or written again.

* A row dated after the batch's own time moves the watermark by nothing, so it settles no other row.
* A key in progress (``busy_col``) holds its changes; a later row of the key that says it is free releases those that have settled.
  The row with the highest sequence says which it is, the last one to arrive among equals.
* A change older than the watermark is released at once; none is dropped for being late.
* A change without a time or a key waits for nothing and comes out as rejected.

Released changes are applied by the log of ``ingest`` (``apply_batch``), so ``read_state`` reads the result, and
``read_waiting`` the changes that wait, from the state store. Times count in milliseconds, as Spark's timers do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch_scope, store
from .ingest import _batches, apply_batch, open_state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
         "ignoreNullFields": "true"}
_OUT = "_row string, _rejected boolean"


class SettleProcessor(StatefulProcessor):
    """Holds a key's changes until their time has settled and the key is free.

    A key has a timer for the earliest of its waiting changes, set anew when that has been released, and none while it is
    in progress. Each call on the state store is a round trip, so a batch reads and writes a key's hold once. Rows come
    out after the last call on the store, which goes by the key that is current then.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, row string")
        self.hold = handle.getValueState("hold", "seq long, busy boolean")

    def _release(self, mark: int) -> list[str]:
        """Take the settled rows out of the list and set the timer for the rest."""
        rows = [tuple(r) for r in self.waiting.get()]
        rest = [r for r in rows if r[0] > mark]
        if len(rest) < len(rows):
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(ms for ms, _ in rest))
        return [row for ms, row in rows if ms <= mark]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, before = timerValues.getCurrentWatermarkInMs(), self.hold.get()
        last, new, bad, out = before, [], [], []
        for r in rows:
            if r.at_ms is None:
                bad.append(r.body)
                continue
            seq = None if r.seq is None or r.seq != r.seq else int(r.seq)
            if r.busy is not None and (last is None or seq is None or seq >= last[0]):
                last = (-(1 << 63) if seq is None else seq, bool(r.busy))
            if r.body is not None:
                new.append((r.at_ms, r.body))
        if last is not None and last != before:
            self.hold.update(last)
        held = last is not None and last[1]
        if before is not None and before[1] and not held:
            out = self._release(mark)
        out += [row for ms, row in new if ms <= mark and not held]
        keep = [(ms, row) for ms, row in new if ms > mark or held]
        if keep:
            self.waiting.appendList(keep)
            if not held:
                self.handle.registerTimer(min(ms for ms, _ in keep))
        for body in bad:
            yield Row(_row=body, _rejected=True)
        for row in out:
            yield Row(_row=row, _rejected=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        hold = self.hold.get()
        if hold is not None and hold[1]:
            return  # the timer is set again when the key is free
        for row in self._release(timerValues.getCurrentWatermarkInMs()):
            yield Row(_row=row, _rejected=False)

    def close(self) -> None:
        pass


def settled_changes(changes: DataFrame, keys: Sequence[str], ts_col: str, settle_seconds: float, seq_col: str = "seq",
                    busy_col: str | None = None, marker: str | None = None) -> DataFrame:
    """The rows of the stream ``changes``, each once its time has settled and its key is free, with ``_rejected``.

    ``busy_col`` says, where not null, whether the row's key is in progress from then on. Rows in which the boolean
    column ``marker`` is true carry that news only and are not released.
    """
    schema = changes.schema
    ts = F.col(ts_col).cast("timestamp")
    ok = ts.isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    row = F.to_json(F.struct(*changes.columns), _JSON)
    event = F.when(ts <= F.current_timestamp(), ts).otherwise(F.timestamp_seconds(F.lit(0)))
    marked = changes.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.when(ok, F.unix_millis(ts)).alias("at_ms"), F.col(seq_col).cast("double").alias("seq"),
        (F.col(busy_col) if busy_col else F.lit(None)).cast("boolean").alias("busy"),
        (F.when(~F.coalesce(F.col(marker), F.lit(False)), row) if marker else row).alias("body"),
        F.coalesce(event, F.timestamp_seconds(F.lit(0))).alias("_event"))
    # The event time only moves the watermark; kept in the rows, Spark would drop the late ones.
    timed = marked.withWatermark("_event", f"{int(settle_seconds * 1000)} milliseconds").drop("_event")
    out = timed.groupBy(*[f"k{i}" for i in range(len(keys))]).transformWithState(
        SettleProcessor(), outputStructType=T._parse_datatype_string(_OUT), outputMode="Append", timeMode="EventTime")
    return out.select(F.from_json("_row", schema, _JSON).alias("_r"), "_rejected").select("_r.*", "_rejected")


def read_waiting(spark: SparkSession, work_dir: str, schema: T.StructType) -> DataFrame:
    """The changes that wait, read from the state store of the last finished batch."""
    state = spark.read.format("statestore").option("path", f"{work_dir}/_checkpoint").option("stateVarName", "waiting").load()
    return state.select(F.from_json("list_element.row", schema, _JSON).alias("_r")).select("_r.*")


def ingest_timed(changes: DataFrame, target: DataFrame, keys: Sequence[str], work_dir: str, ts_col: str,
                 settle_seconds: float, op_col: str = "op", seq_col: str = "seq", busy_col: str | None = None,
                 marker: str | None = None, mode: str = "last", compact_every: int = 16):
    """Apply the stream ``changes`` to ``target`` as each change settles, until no file is left; run again, it goes on.

    ``read_state`` reads the result, ``read_rejects`` the changes without a time or key, ``read_waiting`` those that wait.
    """
    spark, keys = target.sparkSession, list(keys)
    if -1 not in _batches(spark, f"{work_dir}/base") and not _batches(spark, f"{work_dir}/log"):
        open_state(target, work_dir)

    def take(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            got = store(batch, "settled")
            got.where("_rejected").drop("_rejected").write.mode("overwrite").parquet(f"{work_dir}/rejects/batch={batch_id}")
            ready = got.where(~F.col("_rejected")).drop("_rejected", *(c for c in (busy_col, marker) if c))
            apply_batch(ready, work_dir, keys, target.columns, batch_id, op_col, seq_col, mode, compact_every)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)  # the store that keeps lists and timers; a query keeps what it started with
    try:
        q = (settled_changes(changes, keys, ts_col, settle_seconds, seq_col, busy_col, marker).writeStream.foreachBatch(take)
             .option("checkpointLocation", f"{work_dir}/_checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
