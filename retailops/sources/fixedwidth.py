"""Fixed-width text as a data source, ``spark.read.format("fixed_width")``, to read, write and stream.

Options: ``path`` (a folder, of any file system that pyarrow opens), ``layout`` as ``name:start:length:type;...`` with
``start`` from 1, counted in characters, and the type ``string``, ``int``, ``long`` or ``double``; ``bad_records``, a column
that holds the whole record where a field that is not blank does not parse (the field is null then);
``split_bytes``. A blank field is null, a short record's missing fields too. A file is read in splits; a record belongs to the split in
which it starts. The stream takes files in the order of their names, so a new file's name must come after those already
read. The writer pads text with blanks and whole numbers with zeros on the left; a value wider than its field is an error. A
task's file becomes visible when the job is done.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader,
                                    InputPartition, WriterCommitMessage)

BLOCK = 4 << 20
TYPES = {"string": (T.StringType(), pa.string(), None), "int": (T.IntegerType(), pa.int32(), r"^[+-]?\d{1,18}$"),
         "long": (T.LongType(), pa.int64(), r"^[+-]?\d{1,18}$"),
         "double": (T.DoubleType(), pa.float64(), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")}


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the path there; Spark writes local URIs with one slash."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def read_layout(text: str) -> list[tuple[str, int, int, str]]:
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, start, length, *kind = part.split(":")
        out.append((name, int(start), int(length), kind[0] if kind else "string"))
        if out[-1][3] not in TYPES or out[-1][1] < 1 or out[-1][2] < 1:
            raise ValueError(f"layout entry {part}")
    return out


def records(f, start: int, end: int):
    """Lists of the records of the open file ``f`` that start in [start, end)."""
    at, rest, skip = max(start - 1, 0), b"", start > 0
    f.seek(at)
    while at < end:
        block = f.read(BLOCK)
        rest += block
        if skip:
            i = rest.find(b"\n")
            if i < 0:
                at, rest = at + len(rest), b""
                if not block:
                    return
                continue
            at, rest, skip = at + i + 1, rest[i + 1:], False
            if at >= end:
                return
        stop = rest.rfind(b"\n") + 1 if block else len(rest)
        if at + stop > end:  # the last record is the one with the last byte of the split
            last = rest.find(b"\n", end - at - 1)
            stop = last + 1 if last >= 0 else stop
        lines = rest[:stop].decode("utf-8", "replace").split("\n")
        at, rest = at + stop, rest[stop:]
        if stop:
            yield lines if lines[-1] else lines[:-1]
        if not block:
            return


class FixedWidth(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def schema(self) -> T.StructType:
        fields = [T.StructField(n, TYPES[k][0]) for n, _, _, k in read_layout(self.options["layout"])]
        if self.options.get("bad_records"):
            fields.append(T.StructField(self.options["bad_records"], T.StringType()))
        return T.StructType(fields)

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.layout = dict(options), read_layout(options["layout"])

    def files(self) -> list:
        store, path = open_path(self.options["path"])
        found = store.get_file_info(pafs.FileSelector(path, recursive=True))
        visible = lambda f: f.is_file and not any(p[:1] in ("_", ".") for p in f.path[len(path):].strip("/").split("/"))
        return sorted((f for f in found if visible(f)), key=lambda f: f.path)

    def splits(self, files) -> list[Split]:
        size = int(self.options.get("split_bytes", 128 << 20))
        return [Split(f.path, i, min(i + size, f.size)) for f in files for i in range(0, f.size, size)]

    def partitions(self):
        return self.splits(self.files())

    def read(self, split):
        if split is None:  # a folder without files has one empty partition
            return
        store, _ = open_path(self.options["path"])
        with store.open_input_file(split.path) as f:
            for lines in records(f, split.start, split.end):
                yield self.parse(pa.array(lines, pa.string()))

    def parse(self, lines: pa.Array) -> pa.RecordBatch:
        cols, names, bad = [], [], pa.array([False] * len(lines))
        for name, start, length, kind in self.layout:
            _, arrow, pattern = TYPES[kind]
            piece = pc.utf8_rtrim(pc.utf8_slice_codeunits(lines, start - 1, start - 1 + length), " \r")
            if pattern is None:
                col = pc.if_else(pc.equal(piece, ""), pa.scalar(None, pa.string()), piece)
            else:
                piece = pc.utf8_ltrim(piece, " ")
                ok = pc.match_substring_regex(piece, pattern)
                col = pc.cast(pc.if_else(ok, pc.replace_substring_regex(piece, r"^\+", ""), None),
                              pa.int64() if kind == "int" else arrow)
                if kind == "int":
                    fits = pc.fill_null(pc.and_(pc.greater_equal(col, -2**31), pc.less(col, 2**31)), False)
                    ok, col = pc.and_(ok, fits), pc.cast(pc.if_else(fits, col, None), arrow)
                bad = pc.or_(bad, pc.and_(pc.invert(ok), pc.not_equal(piece, "")))
            cols.append(col)
            names.append(name)
        if self.options.get("bad_records"):
            cols.append(pc.if_else(bad, lines, pa.scalar(None, pa.string())))
            names.append(self.options["bad_records"])
        return pa.RecordBatch.from_arrays(cols, names)


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max((f.path for f in self.files()), default="")}

    def partitions(self, start: dict, end: dict):
        return self.splits(f for f in self.files() if start["file"] < f.path <= end["file"])

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite):
        self.path, self.layout, self.overwrite = options["path"], read_layout(options["layout"]), overwrite
        self.types = {f.name: f.dataType for f in schema}
        at = 1
        for name, start, length, _ in self.layout:
            if start != at or name not in self.types:
                raise ValueError(f"{name}: fields to write follow each other and are columns of the table")
            at += length

    def write(self, batches):
        store, path = open_path(self.path)
        store.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.txt"
        with store.open_output_stream(f"{path}/.{name}") as out:
            for b in batches:
                cols = []
                for col, _, length, kind in self.layout:
                    text = pc.fill_null(pc.cast(b.column(col), pa.string()), "")
                    if kind in ("int", "long"):
                        signed = pc.starts_with(text, "-")
                        digits = pc.utf8_replace_slice(text, 0, 1, "")
                        text = pc.if_else(signed, pc.binary_join_element_wise("-", pc.utf8_lpad(digits, length - 1, "0"), ""),
                                          pc.if_else(pc.equal(text, ""), text, pc.utf8_lpad(text, length, "0")))
                    text = pc.utf8_rpad(text, length, " ")
                    if pc.any(pc.or_(pc.greater(pc.utf8_length(text), length), pc.match_substring(text, "\n"))).as_py():
                        raise ValueError(f"a value of {col} does not fit {length} characters of one line")
                    cols.append(text)
                lines = pc.binary_join_element_wise(*cols, "")
                if len(lines):
                    out.write(("\n".join(lines.to_pylist()) + "\n").encode())
        return Written(name)

    def commit(self, messages):
        store, path = open_path(self.path)
        names = {m.name for m in messages if m is not None}
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(path)):
                if f.is_file and f.base_name.lstrip(".") not in names:
                    store.delete_file(f.path)
        for name in names:
            store.move(f"{path}/.{name}", f"{path}/{name}")

    def abort(self, messages):
        store, path = open_path(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{path}/.{m.name}")


def register_fixed_width(spark: SparkSession) -> None:
    """Make ``format("fixed_width")`` known to the session."""
    spark.dataSource.register(FixedWidth)
