"""Typed CSV and Parquet tables, JSON reports and write-once sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.schema import READING_TYPE


def read_typed_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str = READING_TYPE
) -> DataFrame:
    """``.csv`` or ``.csv.gz`` with a header and explicit types, bound by column name.

    Files may order their columns differently: those with the same header line are read together.
    Columns of the schema that a file lacks are NULL.  A gzip file is one task, so its
    rows are spread again behind the scan; plain files are split by Spark and stay.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = []
    for header, files in _headers(spark, path):
        known = {f.name.lower(): f for f in schema}
        fields = [known.get(n.strip().lower()) for n in _names(spark, header)]
        # columns the schema doesn't name are read as text and left out
        as_read = T.StructType(
            [f or T.StructField(f"_other_{i}", T.StringType()) for i, f in enumerate(fields)]
        )
        rows = spark.read.schema(as_read).option("header", "true").option("mode", "PERMISSIVE")
        there = {f.name for f in fields if f}
        part = rows.csv(files).select(
            *[
                (F.col(f"`{f.name}`") if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in schema
            ]
        )
        packed = any(f.endswith((".gz", ".bz2", ".zst")) for f in files)
        parts.append(part.hint("rebalance") if packed else part)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _names(spark: SparkSession, header: str) -> list[str]:
    """The names in a header line as the CSV reader itself cuts it, quotes and all."""
    line = spark.sparkContext.parallelize([header], 1)
    row = spark.read.option("header", "false").csv(line).first()
    return [n or "" for n in row] if row else []


def _headers(spark: SparkSession, path: str | list[str]) -> list[tuple[str, list[str]]]:
    """Distinct header lines and the files that have them; one row per file comes back."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    # the first line is in the split that starts the file, before all others of that split
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    files: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        files.setdefault(row["header"], []).append(row["file"])
    return sorted(files.items())


def write_csv_gz(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").option("compression", "gzip").csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(
    df: DataFrame, path: str, by: list[str] = ("year",), mode: str = "errorifexists"
) -> None:
    """Parquet in one folder per ``by``; the rebalance splits a large folder into many files."""
    spread = df.hint("rebalance", *by) if by else df
    spread.write.mode(mode).partitionBy(*by).parquet(path)


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.write.mode(mode).json(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Does nothing when the table is already there."""
    df.write.mode("ignore").parquet(path)


def only_new(df: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not loaded yet; NULL is a key like any other."""
    there = loaded.select(*[F.col(k).alias(f"_loaded_{k}") for k in keys])
    same = [df[k].eqNullSafe(there[f"_loaded_{k}"]) for k in keys]
    return df.join(there, same, "left_anti")


def append_version(info: DataFrame, path: str) -> None:
    """Append a `dataset_info` row to the table of versions."""
    info.withColumn("run_ts", F.current_timestamp()).write.mode("append").parquet(path)
