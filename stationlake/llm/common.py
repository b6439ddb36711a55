"""Helpers shared by the operators: tables, words, slices of Arrow batches, running numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words, and what is stripped from lines: space, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text handled at once inside a Python task, in characters.
SLICE_CHARS = 2_000_000

#: Rows of a stretch that one task numbers.
STRETCH_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def carried(df: DataFrame, carry: list[str], results: set[str]) -> tuple[list[str], str]:
    """Columns of ``df`` to hand through, and their part of a schema.

    One that is named like a result is left out: the result has the name.
    """
    names = [c for c in carry if c.lower() not in results]
    fields = df.select(*[F.col(f"`{c}`") for c in names]).schema.fields
    return names, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one column ``_row`` of all its columns, safe from names of results."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns that `packed` hid, some of them changed."""
    return df.select(
        *[changed.get(c, F.col("_row").getField(c)).alias(c) for c in names]
    )


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space; `bytes.split` splits at exactly `SPACES`."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    start = size = 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def list_column(values, offsets, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def stretches(rows: int) -> int:
    """Into how many stretches a series of ``rows`` rows is cut."""
    return max(1, -(-rows // STRETCH_ROWS))


def unit_hash(*parts: Column) -> Column:
    """A 63-bit hash, at least 0."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 1)


def hash_spot(h: str) -> Column:
    """Where in [0, 1) a `unit_hash` lies."""
    return F.shiftrightunsigned(F.col(h), 10) / F.lit(float(1 << 53))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    spot: Column,
    value: str,
    name: str,
    rows: int,
) -> DataFrame:
    """Add ``name``: the total of ``value`` over earlier rows of the same keys.

    ``spot`` rises with ``order`` and spreads the rows evenly over [0, 1).  A series is cut into
    stretches of it, so a key with most of the rows is shared by many tasks; totals of
    whole stretches go through a table of one row per key and stretch.  ``df`` is read twice
    and should be a written table.
    """
    cut = df.withColumn("_stretch", F.floor(spot * stretches(rows)).cast("int"))
    sums = cut.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch")
    before = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_stretch").alias("_s"),
        (F.sum("_sum").over(earlier) - F.col("_sum")).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    own = cut.withColumn("_own", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("_stretch") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    total = (F.col("_before") + F.col("_own") - F.col(value)).cast("long")
    return own.join(before, same).select(*df.columns, total.alias(name))
