"""Tables changed file by file (I25, I26, I37, I47): copy-on-write under a commit log.

A folder holds several tables. Data files never change once written; what a table consists of is what the newest commit
says, and a reader opens the files that commit lists. A change finds the files that hold a touched row, writes their rows
anew, and commits the list with those files exchanged: one changed row of a large table costs the files it stands in, not
the table. A commit names the state of every table of the folder and becomes visible by one rename, so a change of several
tables is seen whole or not at all; a writer whose base is no longer the newest commit fails and leaves nothing visible.

Layout of a folder: ``_commits/<n>.json`` names for each table its schema and its manifest; a manifest is a small table of
the data files with their row counts and the smallest and largest value of the table's ``cluster`` column, by which
files without a touched key are passed over unread.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import checked_broadcast


class CommitConflict(RuntimeError):
    """Another writer committed first; read again and repeat the change."""


class FileTables:
    """The tables of the folder ``root`` (a file system that every executor reaches)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._log = self._path(f"{self.root}/_commits")
        self._fs = self._log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # ---- commits

    def versions(self) -> list[int]:
        if not self._fs.exists(self._log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """(version, {table: entry}) of a commit, the newest by default; (0, {}) before the first."""
        all_ = self.versions()
        if version is None:
            version = all_[-1] if all_ else 0
        if not version:
            return 0, {}
        if version not in all_:
            raise ValueError(f"{self.root} has no version {version}")
        stream = self._fs.open(self._path(f"{self.root}/_commits/{version:020d}.json"))
        try:
            return version, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, tables: Mapping[str, dict]) -> int:
        """Make ``tables`` the state after version ``base``; fails if there is a newer one."""
        target = self._path(f"{self.root}/_commits/{base + 1:020d}.json")
        temp = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(dict(tables), sort_keys=True).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._log.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temp, target, options)  # fails where the target exists
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(target):
                raise CommitConflict(f"{self.root}: version {base + 1} was committed by another writer") from e
            raise
        return base + 1

    # ---- reading

    def manifest(self, name: str, version: int | None = None) -> DataFrame:
        """(path, n_rows, lo, hi) of the table's files."""
        entry = self.state(version)[1][name]
        return self.spark.read.schema(self._manifest_type(entry)).parquet(f"{self.root}/{entry['manifest']}")

    def files(self, name: str, version: int | None = None) -> list[str]:
        return sorted(f"{self.root}/{r.path}" for r in self.manifest(name, version).select("path").collect())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest by default."""
        version, tables = self.state(version)
        return self._open(tables[name], self.files(name, version))

    def _open(self, entry: dict, files: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    @staticmethod
    def _manifest_type(entry: dict) -> T.StructType:
        base = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_rows", T.LongType())])
        if entry["cluster"]:
            kind = T.StructType.fromJson(json.loads(entry["schema"]))[entry["cluster"]].dataType
            base = base.add("lo", kind).add("hi", kind)
        return base

    # ---- writing

    def _relative(self, path: Column) -> Column:
        """A data file's name from its full path: the file system may spell the root differently. For one row per
        file: a pattern on the path of every data row costs more than reading the row."""
        return F.regexp_extract(path, r"([^/]+/data/[^/]+/[^/]+)$", 1)

    def _write(self, name: str, entry: dict, df: DataFrame) -> DataFrame:
        """Write new data files and return their manifest rows."""
        folder = f"{self.root}/{name}/data/{uuid.uuid4().hex}"
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        df.write.parquet(folder)
        new = self.spark.read.schema(schema).parquet(folder)
        bounds = [F.min(entry["cluster"]).alias("lo"), F.max(entry["cluster"]).alias("hi")] if entry["cluster"] else []
        rows = new.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"), *bounds)
        return rows.withColumn("path", self._relative(F.col("path")))

    def _entry(self, name: str, entry: dict, rows: DataFrame) -> dict:
        path = f"{name}/manifest/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.root}/{path}")  # a row for each file
        return {**entry, "manifest": path}

    def create(self, name: str, df: DataFrame, cluster: str | None = None, files: int | None = None) -> int:
        """A new table, or new content of a table; ``files`` files (by size, if not given) are cut by ranges of the column
        ``cluster`` if given."""
        base, tables = self.state()
        entry = {"schema": df.schema.json(), "cluster": cluster, "manifest": ""}
        new = self._write(name, entry, df if not cluster else df.repartitionByRange(files, cluster) if files else df.repartitionByRange(cluster))
        return self.commit(base, {**tables, name: self._entry(name, entry, new)})

    def touched(self, name: str, entry: dict, files: DataFrame, hit: Column | DataFrame | list,
                keys: Sequence[str] = ()) -> list[str]:
        """The data files with a row that meets the condition ``hit``, or whose ``keys`` stand in the rows ``hit``
        (null as a value of its own: a change that lets null match nothing leaves such rows as they are).

        A list of (rows, keys) stands for all of them.
        """
        if isinstance(hit, list):
            return sorted({p for rows, cols in hit for p in self.touched(name, entry, files, rows, cols)})
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if isinstance(hit, DataFrame) and entry["cluster"] in keys:
            c = F.col(entry["cluster"])
            low, high, none = hit.agg(F.min(c), F.max(c), F.max(c.isNull())).first()
            if none is None:
                return []
            if not none:  # the bounds of a file say nothing of its nulls
                kind = schema[entry["cluster"]].dataType
                files = files.where((F.col("hi") >= F.lit(low).cast(kind)) & (F.col("lo") <= F.lit(high).cast(kind)))
        listed = [f"{self.root}/{r.path}" for r in files.select("path").collect()]
        if not listed:
            return []
        rows = self.spark.read.schema(schema).parquet(*listed)
        where = F.col("_metadata.file_path").alias("_file")
        if isinstance(hit, DataFrame):
            wanted = checked_broadcast(hit.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).distinct())
            same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
            rows = rows.select(*keys, where).join(wanted, reduce(Column.__and__, same), "left_semi")
        else:
            rows = rows.where(hit).select(where)
        return [r[0] for r in rows.select("_file").distinct().select(self._relative(F.col("_file"))).collect()]

    def change(self, changes: Mapping[str, tuple[Column | DataFrame | list, Sequence[str], Callable[[DataFrame], DataFrame]]],
               base: int | None = None) -> int:
        """Change several tables in one commit: ``{table: (hit, keys, rewrite)}``.

        ``rewrite`` gets all rows of the files that ``hit`` touches (none, if it touches no file) and returns the rows
        that take their place; rows of other files stay as they are, in files that are not opened. Nothing is
        visible before the last table has been written, so a failure leaves every table as it was.
        """
        current, tables = self.state()
        base = current if base is None else base
        if base != current:
            raise CommitConflict(f"{self.root}: version {base} is no longer the newest")
        new = dict(tables)
        for name, (hit, keys, rewrite) in changes.items():
            entry = tables[name]
            listed = self.manifest(name, base)
            gone = self.touched(name, entry, listed, hit, keys)
            rows = rewrite(self._open(entry, [f"{self.root}/{p}" for p in gone]))
            added = self._write(name, entry, rows)
            old = self.spark.createDataFrame([(p,) for p in gone], "path string")
            new[name] = self._entry(name, entry, listed.join(F.broadcast(old), "path", "left_anti").unionByName(added))
        return self.commit(base, new)

    def update_where(self, name: str, cond: Column, sets: Mapping[str, Column]) -> int:
        """``update t set ... where cond``, rewriting only the files with such rows."""
        from ..plans.changes import update_where
        return self.change({name: (cond, (), lambda rows: update_where(rows, cond, sets))})

    def delete_where(self, name: str, cond: Column) -> int:
        """``delete from t where cond``, rewriting only the files with such rows."""
        from ..plans.changes import delete_where
        return self.change({name: (cond, (), lambda rows: delete_where(rows, cond))})

    def apply_changes(self, name: str, changes: DataFrame, keys, **how) -> int:
        """A change set with op codes (see ``plans.changes.apply_changes``), rewriting only the files with a changed key.

        The keys of the changes are stored first, so that the set is read once to find the files and once to apply it.
        """
        from ..plans.changes import apply_changes
        from ..session import store
        keys = [keys] if isinstance(keys, str) else list(keys)
        changes = store(changes, "file-changes")
        return self.change({name: (changes, keys, lambda rows: apply_changes(rows, changes, keys, **how))})

    def merge_upsert(self, name: str, source: DataFrame, keys) -> int:
        """MERGE (see ``plans.changes.merge_upsert``), rewriting only the files with a matched key."""
        from ..plans.changes import merge_upsert
        from ..session import store
        keys = [keys] if isinstance(keys, str) else list(keys)
        source = store(source, "file-merge")
        return self.change({name: (source, keys, lambda rows: merge_upsert(rows, source, keys))})

    def append(self, name: str, rows: DataFrame) -> int:
        """New rows as new files."""
        return self.change({name: (F.lit(False), (), lambda old: rows)})

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` versions and delete the files that no kept version lists; returns how many."""
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]

        def listed(vs):
            found = set()
            for v in vs:
                for name, entry in self.state(v)[1].items():
                    if name.startswith("_"):  # a note of the folder, not a table
                        continue
                    found.add(entry["manifest"])
                    found.update(r.path for r in self.manifest(name, v).select("path").collect())
            return found

        gone = listed(old) - listed(kept)
        for v in old:
            self._fs.delete(self._path(f"{self.root}/_commits/{v:020d}.json"), False)
        for p in gone:
            self._fs.delete(self._path(f"{self.root}/{p}"), True)
        return len(gone)
