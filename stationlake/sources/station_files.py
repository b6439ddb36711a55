"""Raw station files: a preamble of ``KEY:;VALUE`` lines, a header and ``;`` rows.

Files are read by line, so a large file is split over tasks.  What is the same for
a whole file (preamble and header) becomes one row per file and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions import text
from stationlake.operators.ordered import attach, attach_stored
from stationlake.schema import HEADER_ALIASES, MEASURES, READING_TYPE
from stationlake.session import scratch_path

# First words of the preamble lines, accents folded, and our names.
PREAMBLE_KEYS = {
    "REGIAO": "region",
    "UF": "state",
    "ESTACAO": "station",
    "CODIGO WMO": "wmo_code",
    "LATITUDE": "latitude",
    "LONGITUDE": "longitude",
    "ALTITUDE": "altitude",
    "DATA DE FUNDACAO": "founded_year",
}


FILE_COLUMNS = ["obs_date", "obs_hour", *MEASURES]


def read_station_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, line)`` of every line below ``path``."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), text.decode_bytes(F.col("value")).alias("line")
    )


def fields(line: Column) -> Column:
    """Fields of a ``;`` line; a field in ``"`` may hold ``;`` and doubled quotes."""
    field = r'("(?:[^"]|"")*"|[^;]*)(?:;|$)'
    separators = F.length(F.regexp_replace(line, r'"(?:[^"]|"")*"|[^;]', ""))
    # past the last field the pattern matches once more, emptily
    found = F.slice(F.regexp_extract_all(line, F.lit(field), 1), F.lit(1), separators + 1)
    inner = F.transform(
        found,
        lambda c: F.when(
            F.startswith(c, F.lit('"')),
            F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )
    return F.when(F.contains(line, F.lit('"')), inner).otherwise(F.split(line, ";"))


def repair_ragged(row: Column, size: Column) -> Column:
    """Exactly ``size`` fields: longer rows are cut, shorter ones padded with ``''``."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), size)), F.lit(1), size)


def header_key(c: Column) -> Column:
    return text.fold_accents_column(text.standard_header_column(c))


def line_kind(line: Column) -> Column:
    folded = text.fold_accents_column(F.upper(line))
    return (
        F.when(F.trim(line) == "", "blank")
        .when(line.rlike(r"^[^;]*:\s*(;|$)"), "preamble")
        .when(folded.rlike(r"^\"?DATA[^;]*;\"?HORA"), "header")
        .otherwise("data")
    )


def rejected_files(lines: DataFrame) -> DataFrame:
    """``path, reason, lines``: files that `parse_station_lines` can't read, with their data lines.

    Without a header line nobody knows what the cells of a row mean.  Files without any data
    line are named too.
    """
    kind = line_kind(F.col("line"))
    per_file = lines.groupBy("path").agg(
        F.count_if(kind == "header").alias("headers"), F.count_if(kind == "data").alias("lines")
    )
    reason = F.when(F.col("headers") == 0, "no header line").when(F.col("lines") == 0, "no data line")
    return per_file.select("path", reason.alias("reason"), "lines").where("reason is not null")


def _split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the heads, with their ``kind``, and lines of data: read and classified once.

    One pass writes them to a folder each; the heads' is small, so that nothing reads the
    data lines but the parser.
    """
    tagged = lines.select("path", "line", line_kind(F.col("line")).alias("kind")).where("kind <> 'blank'")
    spark, path = lines.sparkSession, scratch_path(lines.sparkSession, "lines")
    tagged.withColumn("part", F.when(F.col("kind") == "data", "data").otherwise("head")).write.partitionBy(
        "part"
    ).parquet(path)
    written = spark.read.schema("path string, line string, kind string, part string").parquet(path)
    return (
        written.where("part = 'head'").select("path", "line", "kind"),
        written.where("part = 'data'").select("path", "line"),
    )


def parse_station_lines(lines: DataFrame, year: Column | None = None) -> DataFrame:
    """Readings in canonical columns from ``(path, line)`` rows.

    ``year`` is the year of the archive; without it the year of the file name counts,
    and where that has none, the year of the reading.
    Text that does not convert becomes NULL, a row of the wrong length is repaired.
    Files without a header line give no rows; `rejected_files` names and counts them.
    """
    heads, data = _split_lines(lines)
    key = header_key(F.regexp_extract("line", r"^([^:]*):", 1))
    heads = heads.select(
        "path",
        F.when(F.col("kind") == "preamble", key).alias("key"),
        F.when(F.col("kind") == "preamble", text.preamble_value(F.col("line"))).alias("value"),
        F.when(F.col("kind") == "header", F.col("line")).alias("header"),
    )
    # one row per file
    files = heads.groupBy("path").agg(
        F.max("header").alias("header"),
        *[
            F.max(F.when(F.col("key").startswith(k), F.col("value"))).alias(f"_{name}")
            for k, name in PREAMBLE_KEYS.items()
        ],
    )
    files = files.where("header is not null")
    header = F.transform(fields(F.col("header")), header_key)
    files = files.select("path", header.alias("header"), *[f"_{n}" for n in PREAMBLE_KEYS.values()])
    files = files.select(
        "path",
        F.size("header").alias("width"),
        F.array(*[_place(name) for name in FILE_COLUMNS]).alias("places"),
        *station_metadata(F.col("path")),
        (text.file_year(F.col("path")) if year is None else year).cast("int").alias("_year"),
    )
    # one small row per file, stored: below the broadcast limit no line is shuffled
    rows = attach_stored(data, files, ["path"], "inner")
    # cells in the order of FILE_COLUMNS; arrays keep the generated code small
    row = repair_ragged(fields(F.col("line")), F.col("width"))
    # the outer transform binds the split row, so that it is split once and not per cell
    picked = F.transform(
        F.array(row), lambda r: F.transform(F.col("places"), lambda at: F.get(r, at - 1))
    )
    cells = rows.withColumn("cells", picked[0])
    numbers = F.transform(
        F.slice("cells", 3, len(MEASURES)), lambda c: text.number(text.decimal_comma(c))
    )
    parsed = cells.select(
        "path",
        text.station_date(F.col("cells")[0]).alias("obs_date"),
        text.station_hour(F.col("cells")[1]).alias("obs_hour"),
        numbers.alias("numbers"),
        *PREAMBLE_KEYS.values(),
        "_year",
    ).withColumns(
        {
            **{m: F.col("numbers")[i] for i, m in enumerate(MEASURES)},
            "ts": text.reading_time(F.col("obs_date"), F.col("obs_hour")),
            "year": F.coalesce("_year", F.year("obs_date")),
        }
    )
    return parsed.select("path", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in READING_TYPE])


def _place(name: str) -> Column:
    """1-based place of a canonical column in the header of a file, else NULL."""
    places = [
        F.nullif(F.array_position("header", alias), F.lit(0)).cast("int")
        for alias, ours in HEADER_ALIASES.items()
        if ours == name
    ]
    return F.coalesce(*places)


def station_metadata(path: Column) -> list[Column]:
    """Preamble values, filled from the file name where empty."""
    out = [
        F.coalesce(F.col(f"_{n}"), text.file_name_part(path, n)).alias(n)
        for n in ("region", "state", "station", "wmo_code")
    ]
    out += [
        text.number(text.decimal_comma(F.col(f"_{n}"))).alias(n)
        for n in ("latitude", "longitude", "altitude")
    ]
    out.append(text.founded_year(F.col("_founded_year"), path).alias("founded_year"))
    return out


def read_station_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Readings of all station files below ``path``."""
    return parse_station_lines(read_station_lines(spark, path))


def standardize_column_names(df: DataFrame) -> DataFrame:
    """Standardised headers, then canonical names where one is known."""
    standard = [text.standard_header(c) for c in df.columns]
    return df.toDF(*[HEADER_ALIASES.get(text.fold_accents(c), c) for c in standard])


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns without a name, as a trailing ``;`` makes them."""

    def named(c: str) -> bool:
        return c.strip() != "" and "UNNAMED" not in c.upper() and not (
            c.startswith("_c") and c[2:].isdigit()
        )

    return df.select([F.col(f"`{c}`") for c in df.columns if named(c)])


def standardize_types(df: DataFrame) -> DataFrame:
    """Cast the known columns that are present; text that does not convert becomes NULL."""
    target = {f.name: f.dataType for f in READING_TYPE}
    casts = {}
    for c, kind in target.items():
        if c not in df.columns:
            continue
        source = F.col(c)
        if c in MEASURES or c in ("latitude", "longitude", "altitude"):
            casts[c] = text.number(source)
        else:
            casts[c] = source.try_cast(kind)
    return df.withColumns(casts)


def add_year_drop_founded(df: DataFrame, path: Column | None = None) -> DataFrame:
    """``year`` from the file name if missing; the founding year is dropped."""
    if "year" not in df.columns:
        df = df.withColumn("year", text.file_year(path if path is not None else F.col("path")))
    return df.drop("founded_year")


def attach_station_metadata(rows: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    """Station columns on every reading."""
    return attach(rows, stations, keys)


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([c for c in names if c in df.columns])


def drop_hour(df: DataFrame) -> DataFrame:
    return df.drop("obs_hour")
