"""Spark session defaults and the shared checkpoint folder.

Everything in the library takes a ``SparkSession`` from the caller; this module only
offers a builder with sane defaults for local runs and tests, and the one place that
decides where lineage-cutting writes go.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE re-plans joins and partition counts from real
# shuffle sizes, splits skewed join partitions, and UTC keeps timestamps equal to the
# naive timestamps DuckDB reads from the same parquet files.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "retailops",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster leave ``master`` unset so spark-submit decides; set
    ``shuffle_partitions`` to roughly input bytes / 128 MB for the largest stage.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: float, partition_bytes: int = 256 << 20, executors: int = 1000,
                 cores_per_executor: int = 8, broadcast_bytes: int = 64 << 20) -> dict[str, str]:
    """Settings sized for a cluster run over ``input_bytes`` of parquet.

    * splits and shuffle partitions of about ``partition_bytes`` so each task's
      slice fits in executor memory with room to sort/aggregate without spilling;
    * the initial shuffle partition count covers the largest input (AQE coalesces
      small stages back down to the advisory size, so small queries do not pay for it)
      and is at least a few waves of the cluster's cores;
    * AQE splits skewed join partitions above 4x the median (and above
      ``partition_bytes``), and converts joins to broadcast at run time only below
      ``broadcast_bytes`` of measured shuffle output.

    Example: 100 TB on 1000 executors x 8 cores -> about 409,600 initial partitions of
    256 MB, coalesced per stage by AQE.
    """
    cores = executors * cores_per_executor
    parts = max(int(input_bytes // partition_bytes) + 1, 3 * cores)
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a folder every executor can reach; that setting is always used as
    is. Only where it is unset and the master is local is a private folder made, which
    goes when the process ends; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder is invisible to the other executors
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="retailops-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    return path


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scratch scopes", default=())


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete what ``scratch_path`` and ``store`` made within, when the block ends.

    For work whose result is written inside the block (a micro-batch, a step of an iteration); a DataFrame that reads
    such a table does not outlive it. Scopes nest; each thread has its own.
    """
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        drop_scratch(spark, *made)


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete folders made by ``scratch_path``."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back.

    The input runs once, lineage is cut, and the planner knows the table's size. A lost
    executor costs a re-read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
