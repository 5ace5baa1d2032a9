"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import scratch_path

# Bytes outside words: a word is a run of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z.
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
WORD_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in _KEEP else 32
                   for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(name: str = "text") -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def plain_words(text: str) -> list[bytes]:
    """Words of letters a-z, digits and everything beyond ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split()


def space_words(text: str) -> list[bytes]:
    """Words between blanks, tabs and line ends, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


def crc_text(col: Column) -> Column:
    """crc32 of a value as text; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` takes an iterator of {column: list} batches and yields {column: list or array}."""
    spark_schema: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        for out in fn(b.to_pydict() for b in batches):
            cols = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type)
                    for f in arrow]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, spark_schema)


def stage_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage is cut, sizes are known. ``options``: of the writer."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expand [start, start + length) for each row: (row numbers, values)."""
    length = np.maximum(length, 0)
    row = np.repeat(np.arange(len(start)), length)
    first = np.cumsum(length) - length
    return row, np.arange(len(row)) - first[row] + start[row]


def bucket_counts(spark: SparkSession) -> int:
    """How many partitions a shuffle of the session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
