"""Yearly zip archives of station files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stationlake.functions.text import base_name, decode_bytes
from stationlake.sources.station_files import parse_station_lines

LINES_PER_BATCH = 20_000
LINE_SCHEMA = "archive string, member string, line binary"

#: Stores in which a task can read a part of a file by itself.
RANGE_STORES = {"": "", "file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


def _is_station_file(member: str) -> bool:
    return member.upper().endswith(".CSV")


def _line_batches(lines, size: int) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    for line in lines:
        held.append(line.rstrip(b"\r\n"))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def scheme_of(path: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found[1].lower() if found else ""


def open_store(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    scheme = scheme_of(path)
    if scheme not in RANGE_STORES:
        raise ValueError(f"no range reads from {scheme}:")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(RANGE_STORES[scheme] + path[len(scheme) :])


@dataclass
class Member(InputPartition):
    """One station file of one archive."""

    archive: str
    member: str


class ZipMemberReader(DataSourceReader):
    """One partition per member; the driver reads nothing but the directories of the archives."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def archives(self) -> list[str]:
        from pyarrow import fs

        out = []
        for path in self.paths:
            store, inner = open_store(path)
            prefix = path[: len(path.rstrip("/")) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else ""
            info = store.get_file_info(inner)
            if info.type == fs.FileType.File:
                out.append(path)
            else:
                below = store.get_file_info(fs.FileSelector(inner, recursive=True))
                out += [prefix + f.path for f in below if f.is_file and f.path.lower().endswith(".zip")]
        return sorted(out)

    def members(self, archive: str) -> list[Member]:
        store, inner = open_store(archive)
        with store.open_input_file(inner) as file, zipfile.ZipFile(file) as found:
            return [Member(archive, m) for m in found.namelist() if _is_station_file(m)]

    def partitions(self) -> list[Member]:
        with ThreadPoolExecutor(16) as pool:
            return [m for found in pool.map(self.members, self.archives()) for m in found]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(partition.archive)
        with store.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
            with archive.open(partition.member) as lines:
                for held in _line_batches(lines, LINES_PER_BATCH):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([partition.archive] * len(held)),
                            pa.array([partition.member] * len(held)),
                            pa.array(held, pa.binary()),
                        ],
                        ["archive", "member", "line"],
                    )


class ZipMembers(DataSource):
    """Lines of the station files in the zip archives at ``path``.

    A task reads the directory of one archive and the bytes of one member, and unpacks it as a stream.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema) -> ZipMemberReader:
        return ZipMemberReader(self.options["path"].split("\n"))


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in filter(_is_station_file, archive.namelist()):
                    with archive.open(member) as lines:
                        for held in _line_batches(lines, LINES_PER_BATCH):
                            yield pd.DataFrame({"archive": path, "member": member, "line": held})


def archive_lines(archives: DataFrame) -> DataFrame:
    """``(archive, member, line)`` of every ``.csv`` member of ``(path, content)`` archives.

    Members are unpacked as a stream; only the packed archive is held in memory.
    One archive is one task.
    """
    return archives.select("path", "content").mapInPandas(_lines, LINE_SCHEMA)


def member_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(archive, member, line)`` of archives in a store that tasks can read: one task a member."""
    spark.dataSource.register(ZipMembers)
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("zip_members").load("\n".join(paths))


def read_zip_archives(spark: SparkSession, path: str) -> DataFrame:
    """Readings of all zips at ``path``; the year is the name of the archive.

    Archives in a store that only Spark can read are taken whole, one per task and 2 GB at most.
    """
    if scheme_of(path) in RANGE_STORES:
        return parse_members(member_lines(spark, path))
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return parse_archives(archives)


def parse_archives(archives: DataFrame) -> DataFrame:
    return parse_members(archive_lines(archives))


def parse_members(lines: DataFrame) -> DataFrame:
    """Readings from ``(archive, member, line)``, unpacked once: the parser writes what it classifies."""
    year = F.regexp_extract(
        base_name(F.split_part("path", F.lit("!"), F.lit(1))), r"^([^.]*)", 1
    ).try_cast("int")
    named = lines.select(
        F.concat_ws("!", "archive", "member").alias("path"), decode_bytes(F.col("line")).alias("line")
    )
    return parse_station_lines(named, year)
