"""Parsing of station text: headers, numbers, dates, hours and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: file name pattern of a station-year file.
FILE_NAME_PATTERN = r"INMET_([A-Z]{1,2})_([A-Z]{2})_([A-Z0-9]+)_(.*?)_\d{2}-\d{2}-\d{4}"
FILE_NAME_PARTS = {"region": 1, "state": 2, "wmo_code": 3, "station": 4}

ACCENTED = "ÁÀÂÃÉÊÍÓÔÕÚÜÇ"
PLAIN = "AAAAEEIOOOUUC"


def standard_header(name: str) -> str:
    """Upper case, no ``, ( )``, ``Ç`` as ``C``, no outer blanks."""
    return name.upper().translate(str.maketrans("Ç", "C", ",()")).strip()


def fold_accents(name: str) -> str:
    return name.translate(str.maketrans(ACCENTED, PLAIN))


def standard_header_column(c: Column) -> Column:
    """`standard_header` for header text held in a column."""
    return F.trim(F.translate(F.upper(c), "Ç,()", "C"))


def fold_accents_column(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def decode_bytes(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, otherwise Latin-1."""
    raw = content.cast("binary")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )


def decimal_comma(c: Column) -> Column:
    return F.translate(c, ",", ".")


def number(c: Column, to: str = "float") -> Column:
    """Number from text; text that is no finite number gives NULL."""
    parsed = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast(to)
    if to in ("float", "double"):
        return F.when(~F.isnan(parsed) & (F.abs(parsed) < float("inf")), parsed)
    return parsed


def station_date(c: Column) -> Column:
    """Date from ``yyyy/MM/dd`` or ``yyyy-MM-dd`` with an optional time after it.

    The pattern keeps the cast from failing by exception, which is slow per row.
    """
    day = F.regexp_extract(
        F.trim(c), r"^(\d{4}/\d{1,2}/\d{1,2}|\d{4}-\d{1,2}-\d{1,2})(?:[ T].*)?$", 1
    )
    return F.translate(day, "/", "-").try_cast("date")


def station_hour(c: Column) -> Column:
    """Hour from ``13:00``, ``1300 UTC`` or ``1300``; anything else gives NULL."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(
        c.contains(":"), F.trim(F.split_part(c, F.lit(":"), F.lit(1))).try_cast("int")
    ).when(F.length(digits) >= 2, F.substring(digits, 1, 2).try_cast("int"))


def short_hour(c: Column) -> Column:
    """Hour of a treated file, where a single digit such as ``7`` is also allowed."""
    return F.coalesce(
        station_hour(c), F.when(F.trim(c).rlike("^[0-9]$"), F.trim(c).try_cast("int"))
    )


def reading_time(day: Column, hour: Column) -> Column:
    """Timestamp without zone of a date and an hour 0..23, else NULL."""
    return F.when(
        hour.between(0, 23),
        F.make_timestamp_ntz(
            F.year(day), F.month(day), F.dayofmonth(day), hour, F.lit(0), F.lit(0)
        ),
    )


def time_or_date(ts: Column, day: Column) -> Column:
    return F.coalesce(ts, day.cast("timestamp_ntz"))


def preamble_value(line: Column) -> Column:
    """Text after the first ``:`` without leading ``;``."""
    value = F.regexp_extract(line, r"^[^:]*:\s*;*(.*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(value, r";+\s*$", "")), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_name_part(path: Column, part: str) -> Column:
    """Region, state, wmo code or station from a station file name."""
    found = F.regexp_extract(base_name(path), FILE_NAME_PATTERN, FILE_NAME_PARTS[part])
    return F.nullif(found, F.lit(""))


def founded_year(value: Column, path: Column) -> Column:
    """Year of a ``dd/MM/yyyy`` date, else the first four digits of the file name."""
    iso = F.regexp_replace(F.trim(value), r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1")
    parsed = F.year(F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), iso.try_cast("date")))
    from_name = F.regexp_extract(base_name(path), r"\d{4}", 0).try_cast("int")
    return F.when(F.trim(value) != "", F.coalesce(parsed, from_name))


def file_year(path: Column) -> Column:
    """Last four characters of the stem, else a year between underscores."""
    stem = F.regexp_replace(base_name(path), r"(\.[A-Za-z]+)+$", "")
    return F.coalesce(
        F.regexp_extract(stem, r"(\d{4})$", 1).try_cast("int"),
        F.regexp_extract(stem, r"_(\d{4})_", 1).try_cast("int"),
    )
