"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a generated method beyond this is never compiled by the JVM; smaller stages run faster
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cpus: str = "8", name: str = "stationlake") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application."""
    context = spark.sparkContext
    if any(name.endswith("/stationlake.zip") for name in context.listFiles):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stationlake-"), "stationlake.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    source = os.path.join(folder, name)
                    archive.write(source, os.path.relpath(source, os.path.dirname(here)))
    context.addPyFile(path)


TARGET_PARTITION_BYTES = 128 * 1024 * 1024

#: More partitions than this cost the driver more than they spare the tasks.
MOST_PARTITIONS = 50_000

_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, *paths: str) -> int:
    """Let shuffles of the next query start with about 128 MB of its inputs per partition.

    Adaptive execution merges partitions that turn out small.  Inputs for which the session's number of
    partitions is enough take back what an earlier call has set.  Returns the number in force.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(hadoop).getContentSummary(path).getLength()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_PARTITIONS, -(-total // TARGET_PARTITION_BYTES))
    if wanted > usual:
        spark.conf.set(_INITIAL, str(wanted))
    else:
        spark.conf.unset(_INITIAL)
    return max(wanted, usual)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    folder of one machine is lost with that machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    already_set = context.getCheckpointDir()
    if already_set:
        return already_set.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stationlake-"))
    return context.getCheckpointDir().rstrip("/")


_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared scratch root."""
    _MADE.append(f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders of this driver and return how many there were.

    Only for the end of a job: frames that still read them fail afterwards.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        count += bool(path.getFileSystem(hadoop).delete(path, True))
    return count


def materialise(df, label: str):
    """Write a stage that several later steps read, and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
