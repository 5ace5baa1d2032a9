"""Sources and sinks.

Tables live as parquet under an environment root (``prd``, ``accp``, a test folder).
Fixed-width CHAR text from a source system is right-trimmed once, when it enters
(``read_remote``, ``refresh``, ``stage`` with ``trim=True``), so values compare the
way the source databases compare them; tables already in canonical form are read
as they are (``read_table``), which keeps string predicates pushed down to the
parquet scan (a filter on ``rtrim(col)`` cannot be pushed). Every write goes to a
path that is not being read.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def table_path(root: str, name: str) -> str:
    """``root/name.parquet`` when that exists as a file set, else ``root/name``."""
    root = root.rstrip("/")
    return f"{root}/{name}.parquet" if not name.endswith(".parquet") else f"{root}/{name}"


def rtrim_strings(df: DataFrame) -> DataFrame:
    """Right-trim every string column (CHAR semantics: trailing blanks do not count)."""
    cols = [F.rtrim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def read_table(spark: SparkSession, root: str, name: str,
               columns: Sequence[str] | None = None, trim: bool = False) -> DataFrame:
    """A1: read ``name`` from the environment at ``root``.

    ``trim=True`` right-trims every string column (for blank-padded CHAR data that
    was not normalised on the way in); it costs parquet pushdown of predicates on
    those columns, so canonical tables are read untrimmed.
    """
    df = spark.read.parquet(table_path(root, name))
    if columns:
        df = df.select(*columns)
    return rtrim_strings(df) if trim else df


def register_environment(spark: SparkSession, env: str, root: str, names: Iterable[str]) -> list[str]:
    """Make ``env.<name>`` resolvable in Spark SQL for every table under ``root``.

    Creates the database ``env`` (e.g. ``prd``, ``accp``) and one external parquet
    table per name pointing at ``root`` (no data is copied), so SQL written against
    environment-qualified names runs as ``spark.sql("select ... from prd.orders")``.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {env}")
    out = []
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {env}.{name}")
        spark.sql(f"CREATE TABLE {env}.{name} USING parquet LOCATION '{table_path(root, name)}'")
        out.append(f"{env}.{name}")
    return out


def read_remote(spark: SparkSession, source: str | Mapping[str, str], table: str,
                trim: bool = True) -> DataFrame:
    """A2: a table of another system.

    ``source`` is either a second parquet root or a dict of JDBC options
    (``url``, ``user``, ``password``, ``driver`` ...); the local join is then an
    ordinary Spark join.
    """
    if isinstance(source, Mapping):
        df = spark.read.format("jdbc").options(**source).option("dbtable", table).load()
        return rtrim_strings(df) if trim else df
    return read_table(spark, source, table, trim=trim)


def snapshot(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> DataFrame:
    """A3: save a query as a table and return the saved table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage(frames: Mapping[str, DataFrame], root: str | None = None) -> dict[str, DataFrame]:
    """A4: materialise extracts from several systems before joining them.

    Each stage is written once (under ``root`` or the shared checkpoint folder) and
    read back, so a lost executor re-reads the stage instead of re-running the
    extract, and the later join starts from known file sizes.
    """
    out = {}
    for name, df in frames.items():
        path = f"{root.rstrip('/')}/{name}" if root else scratch_path(df.sparkSession, name)
        out[name] = snapshot(df, path)
    return out


def bucket_table(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """Write ``df`` as an external table bucketed and sorted on ``keys``.

    Two tables bucketed the same way on their join key (same bucket count) join
    without a shuffle on either side: tables joined again and again on one key
    (orders and line items on the order key) pay the shuffle once, at write time.
    Returns the table as read back through the catalog (where the bucketing is
    known to the planner).
    """
    (df.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
       .format("parquet").saveAsTable(name))
    # statistics after a bulk load: row count and size for the cost-based planner
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    return df.sparkSession.table(name)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> DataFrame:
    """Write ``df`` as the new content of ``path`` without ever exposing a half table.

    The new version is written beside the old one; only after that write has
    succeeded is the old folder renamed away and the new one renamed into place
    (then the old one is deleted). A failure while writing leaves the old table as
    it was, and ``df`` may be computed from the very table it replaces, since the
    old files are still there while it is written. Folder renames are atomic on
    HDFS-like file systems; on object stores, where a rename is a copy, write
    versioned paths (``.../v=<stamp>``) and point readers at the newest instead.
    """
    import uuid
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    tag = uuid.uuid4().hex[:12]
    staging = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.__new-{tag}")
    backup = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.__old-{tag}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(staging.toString())
    had_old = fs.exists(target)
    if had_old and not fs.rename(target, backup):
        raise IOError(f"could not move {path} aside")
    if not fs.rename(staging, target):
        if had_old:
            fs.rename(backup, target)
        raise IOError(f"could not move the new version into {path}")
    if had_old:
        fs.delete(backup, True)
    return spark.read.parquet(path)


def refresh(spark: SparkSession, src_root: str, dst_root: str, names: Iterable[str],
            keep: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None,
            trim: bool = True) -> dict[str, int]:
    """Full refresh of a list of tables from one environment into another.

    Text is right-trimmed on the way in (``trim``), so the copies are canonical.
    ``keep`` limits a table to keys present in another table (left semi join). Returns
    the row count written per table, the load report the reference logs.
    """
    counts = {}
    keep = keep or {}
    for name in names:
        df = read_table(spark, src_root, name, trim=trim)
        if name in keep:
            keys_df, on = keep[name]
            df = df.join(keys_df.select(*on).distinct(), list(on), "left_semi")
        written = snapshot(df, table_path(dst_root, name))
        counts[name] = written.count()
    return counts


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _list_partition_values(spark: SparkSession, root: str, column: str) -> list[str]:
    fs, hroot = _fs(spark, root)
    if not fs.exists(hroot):
        return []
    prefix = f"{column}="
    vals = []
    for st in fs.listStatus(hroot):
        n = st.getPath().getName()
        if st.isDirectory() and n.startswith(prefix):
            vals.append(n[len(prefix):])
    return sorted(vals)


def _delete_partition(spark: SparkSession, root: str, column: str, value: str) -> None:
    fs, _ = _fs(spark, root)
    jvm = spark.sparkContext._jvm
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{column}={value}"), True)


def archive(df: DataFrame, root: str, stamp: _dt.date, keep_days: int = 45) -> DataFrame:
    """Dated archive with retention.

    Writes ``df`` as partition ``snapshot=stamp`` (dynamic partition overwrite, so a
    re-run of the same day replaces only that day) and drops partitions older than
    ``stamp - keep_days``. Returns the archive as it stands.
    """
    spark = df.sparkSession
    (df.withColumn("snapshot", F.lit(stamp.isoformat()))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("snapshot").parquet(root))
    cut = stamp - _dt.timedelta(days=keep_days)
    for v in _list_partition_values(spark, root, "snapshot"):
        if _dt.date.fromisoformat(v) < cut:
            _delete_partition(spark, root, "snapshot", v)
    return spark.read.parquet(root)


def backup_generations(df: DataFrame, root: str, n: int = 7) -> DataFrame:
    """Keep the last ``n`` backups of rows about to be deleted.

    Each call writes a new generation ``gen=k`` (k one above the newest) and removes
    all but the newest ``n``; generation numbers never get reused so a re-read
    during a run never sees a half-renamed folder.
    """
    spark = df.sparkSession
    gens = sorted(int(v) for v in _list_partition_values(spark, root, "gen"))
    new = (gens[-1] + 1) if gens else 1
    (df.withColumn("gen", F.lit(new)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("gen").parquet(root))
    for g in (gens + [new])[:-n]:
        _delete_partition(spark, root, "gen", str(g))
    return spark.read.parquet(root)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """CSV report sink (one folder of part files; no single-file funnel)."""
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def write_text(df: DataFrame, path: str, col: str = "record") -> None:
    """A11 sink: one fixed-width record per line (a folder of part files, in
    partition order, which is the sort order after an ``orderBy``)."""
    df.select(col).write.mode("overwrite").text(path)


def parse_fixed(df: DataFrame, col: str, layout: Sequence[tuple],
                keep: Sequence[str] = ()) -> DataFrame:
    """A10: split fixed-position text into typed columns.

    ``layout`` entries are ``(name, start, length[, type])`` with 1-based ``start``;
    a value that does not parse becomes null (``try_cast``) instead of failing the
    job, as bad payload rows must not stop an error report.
    """
    out = [F.col(k) for k in keep]
    for entry in layout:
        name, start, length = entry[:3]
        typ = entry[3] if len(entry) > 3 else "string"
        piece = F.rtrim(F.substring(F.col(col), start, length))
        if typ != "string":
            piece = piece.try_cast(typ)
        out.append(piece.alias(name))
    return df.select(*out)


def _digits(c: Column) -> Column:
    return F.coalesce(F.floor(F.abs(c)).cast("decimal(38,0)").cast("string"), F.lit("0"))


def fits_fixed(layout: Sequence[tuple]) -> Column:
    """Whether every number of a record fits its field (see ``format_fixed``)."""
    ok = F.lit(True)
    for c, width, kind in layout:
        if kind == "num":
            ok = ok & (F.length(_digits(F.col(c) if isinstance(c, str) else c)) <= width)
    return ok


def format_fixed(layout: Sequence[tuple], sep: str = "") -> Column:
    """One fixed-width record from columns.

    ``layout`` entries are ``(column_or_expr, width, kind)``: ``kind`` ``"num"`` pads
    the absolute value with zeros on the left (null: all zeros), ``"text"`` pads with blanks
    on the right and cuts to width (null: blanks). A number wider than its field is an
    error; ``fits_fixed`` tells such rows beforehand.
    """
    from ..functions.cols import zero_padded
    parts = []
    for c, width, kind in layout:
        c = F.col(c) if isinstance(c, str) else c
        if kind == "num":
            parts.append(zero_padded(_digits(c), width))
        else:
            parts.append(F.rpad(F.coalesce(c.cast("string"), F.lit("")), width, " "))
    return F.concat_ws(sep, *parts) if sep else F.concat(*parts)


def rows(spark: SparkSession, data: Sequence[Sequence], schema) -> DataFrame:
    """Literal rows as a source."""
    return spark.createDataFrame(list(data), schema)


def keys_in(df: DataFrame, col: str, keys: Sequence) -> DataFrame:
    """Keep rows whose ``col`` is in a long literal key list.

    The list becomes a one-column DataFrame; its size is known to the planner, which
    broadcasts or shuffles it accordingly.
    """
    from ..operators.joins import has
    spark = df.sparkSession
    dtype = df.schema[col].dataType
    kdf = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)],
                                T.StructType([T.StructField(col, dtype)]))
    return has(df, kdf, [col])


def sample_rows(df: DataFrame, n: int, seed: int, key_cols: Sequence[str] | None = None) -> DataFrame:
    """A repeatable random sample of ``n`` rows.

    Ordering by a seeded hash of the row (not ``rand``) gives the same rows whatever
    the partitioning; ``orderBy().limit()`` plans as a per-task top-n, so no task
    ever holds more than ``n`` rows.
    """
    cols = list(key_cols or df.columns)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return df.orderBy(h, *cols).limit(n)
