"""Links to yearly archives in a table of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_links(
    pages: DataFrame, suffix: str = ".zip", html: str = "html", base: str = "url"
) -> DataFrame:
    """Every ``<a href>`` that ends in ``suffix``, as an absolute address with its year.

    A relative link is joined to the scheme and host of the page.
    """
    host = F.regexp_extract(base, r"^([a-zA-Z]+://[^/]+)", 1)
    found = pages.withColumn(
        "href",
        F.explode(F.regexp_extract_all(html, F.lit(r"<a\s[^>]*?href=[\"']([^\"']+)[\"']"), 1)),
    ).filter(F.endswith("href", F.lit(suffix)))
    absolute = F.when(F.col("href").rlike("^[a-zA-Z]+://"), F.col("href")).otherwise(
        F.concat(host, F.lit("/"), F.regexp_replace("href", "^/+", ""))
    )
    name = F.element_at(F.split("href", "/"), -1)
    year = F.split_part(name, F.lit("."), F.lit(1)).try_cast("int")
    return found.withColumn("link", absolute).withColumn("year", year)


def filter_year_range(
    df: DataFrame, start: int | None = None, end: int | None = None, year: str = "year"
) -> DataFrame:
    """Both bounds: inclusive range; only the first: that year; none: all known years."""
    known = df.filter(F.col(year).isNotNull())
    if start is not None and end is not None:
        return known.filter(F.col(year).between(start, end))
    if start is not None:
        return known.filter(F.col(year) == start)
    return known
