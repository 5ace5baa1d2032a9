"""I32: surrogate keys from reserved blocks, without a sort and without reading the table that holds the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.filetables import CommitConflict, FileTables

_PLACES = (1 << 33) - 1  # the low bits of monotonically_increasing_id: a row's place in its task


class KeyBlocks:
    """An allocator stored in the folder ``root``: a counter under a commit log, and the blocks of every job.

    A job's new rows are written once with the task and the place that each had there. Its tasks' row counts are its
    blocks; one commit moves the counter past all of them. A row's key is the start of its block and its place, so a task
    repeated by Spark, a job run again under its name (also after a failure at any step) and a reader of the
    result get the same keys. Of two jobs that reserve at once, the later takes the next range. Keys of a job have no
    gaps; their order says nothing. One job's name is not to be run twice at the same time.
    """

    def __init__(self, spark: SparkSession, root: str, first: int = 1):
        self.spark, self.root, self.first = spark, root.rstrip("/"), first
        self.log = FileTables(spark, self.root)

    def _written_once(self, df, path: str) -> DataFrame:
        if not self.log._fs.exists(self.log._path(f"{path}/_SUCCESS")):
            df().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def reserve(self, job: str, total: int) -> int:
        """The first key of the job's range; a job that has one keeps it."""
        while True:
            version, state = self.log.state()
            if job in state.get("jobs", {}):
                return state["jobs"][job]
            start = state.get("next", self.first)
            try:
                self.log.commit(version, {"next": start + total, "jobs": {**state.get("jobs", {}), job: start}})
                return start
            except CommitConflict:
                continue  # another job was first: read its counter

    def assign(self, new_rows: DataFrame, job: str, key_col: str) -> DataFrame:
        """``new_rows`` with ``key_col``: the rows of the job's first run, whatever is passed later under its name.

        No rows reserve nothing; nulls and repeated rows each get a key of their own. ``key_col``, ``key_block`` and
        ``key_place`` are not to be columns of ``new_rows``.
        """
        clash = {key_col, "key_block", "key_place"} & set(new_rows.columns)
        if clash:
            raise ValueError(f"columns of new_rows: {sorted(clash)}")
        rows = self._written_once(lambda: new_rows.select(
            "*", F.spark_partition_id().alias("key_block"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACES)).alias("key_place")), f"{self.root}/rows/{job}")
        before = Window.orderBy("key_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
        blocks = self._written_once(lambda: rows.groupBy("key_block").agg(F.count(F.lit(1)).alias("n")).select(
            "key_block", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), f"{self.root}/blocks/{job}")
        first = self.reserve(job, blocks.agg(F.sum("n")).first()[0] or 0)
        return rows.join(F.broadcast(blocks.drop("n")), "key_block").select(
            *new_rows.columns, (F.lit(first) + F.col("start") + F.col("key_place")).cast("long").alias(key_col))

    def forget(self, job: str) -> None:
        """Delete the rows and blocks of a job whose result has been used; its range stays taken."""
        for part in ("rows", "blocks"):
            self.log._fs.delete(self.log._path(f"{self.root}/{part}/{job}"), True)
