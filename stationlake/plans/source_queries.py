"""Sources, sinks and text parsing over texts derived from the given tables."""

from __future__ import annotations

import io
import zipfile
from functools import partial

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.functions import text
from stationlake.operators.ordered import attach
from stationlake.plans.registry import big, query, sql_stamp, stamp, t, tidy
from stationlake.plans.standins import table
from stationlake.session import scratch_path
from stationlake.sources import archives, links, station_files, tables

# --- files written by Spark from the events, then read back ---

HEADER = (
    "DATA (YYYY-MM-DD);HORA (UTC);PRECIPITAÇÃO TOTAL, HORÁRIO (mm);"
    "TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);UMIDADE RELATIVA DO AR, HORARIA (%);"
)


def _comma(c):
    return F.regexp_replace(F.col(c).cast("string"), r"\.", ",")


def _data_line():
    k = F.get_json_object("props", "$.k")
    return F.concat_ws(
        ";", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:00"), _comma("value"),
        F.when(k == "7", "-9999").when(k == "8", "").otherwise(_comma("value")), k, F.lit(""),
    )


def write_station_days(events, path):
    """One raw station file per station and day."""
    dated = events.select(
        F.col("event_type").alias("station"), F.date_format("ts", "yyyyMMdd").alias("day"),
        F.col("ts"), F.col("event_id"), _data_line().alias("value"),
    )
    preamble = [
        F.lit("REGIAO:;CO"), F.lit("UF:;DF"), F.concat(F.lit("ESTACAO:;"), F.upper("station")),
        F.concat(F.lit("CODIGO (WMO):;A"), F.length("station").cast("string")),
        F.lit("LATITUDE:;-15,78"), F.lit("LONGITUDE:;-47,92"), F.lit("ALTITUDE:;1159,54"),
        F.lit("DATA DE FUNDACAO:;07/05/2000"), F.lit(HEADER),
    ]
    heads = dated.select("station", "day").distinct().select(
        "station", "day", F.posexplode(F.array(*preamble)).alias("line_no", "value")
    ).select(
        "station", "day", "line_no", F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("long").alias("event_id"), "value",
    )
    body = dated.select("station", "day", F.lit(9).alias("line_no"), "ts", "event_id", "value")
    (
        heads.unionByName(body)
        .repartition("station", "day")
        .sortWithinPartitions("station", "day", "line_no", "ts", "event_id")
        .select("station", "day", "value")
        .write.partitionBy("station", "day")
        .text(path)
    )


STATION_DAY_SQL = f"""SELECT upper(event_type) AS station, 'A' || length(event_type) AS wmo_code,
 strftime(ts, '%Y-%m-%d') AS obs_date, CAST(hour(ts) AS BIGINT) AS obs_hour, CAST(year(ts) AS BIGINT) AS "year",
 2000::BIGINT AS founded_year, {t('CAST(1159.54 AS FLOAT)')} AS altitude, count(*) AS "rows",
 round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)) + 3e-8, 3) AS precip_sum,
 round(sum(CASE k WHEN 7 THEN -9999 WHEN 8 THEN NULL ELSE CAST(CAST(value AS FLOAT) AS DOUBLE) END) + 3e-8, 3) AS temp_sum,
 {t('sum(k)')} AS humidity_sum
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY ALL"""


def _station_hours(parsed):
    return parsed.groupBy(
        "station", "wmo_code", F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"),
        big("obs_hour").alias("obs_hour"), big("year").alias("year"),
        big("founded_year").alias("founded_year"), tidy("altitude").alias("altitude"),
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(F.col("precip_mm").cast("double")) + 3e-8, 3).alias("precip_sum"),
        F.round(F.sum(F.col("temp_c").cast("double")) + 3e-8, 3).alias("temp_sum"),
        tidy(F.sum("humidity")).alias("humidity_sum"),
    )


@query("read_station_files", STATION_DAY_SQL)
def read_station_files(spark, sf_dir):
    path = scratch_path(spark, "station-files")
    write_station_days(table(spark, sf_dir, "events"), path)
    return _station_hours(station_files.read_station_files(spark, path))


def _pack(batches):
    """One archive per Arrow batch, one Latin-1 member per station in a folder."""
    for number, batch in enumerate(batches):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for station, lines in batch.groupby("station", sort=True):
                head = [
                    "REGIAO:;CO", "UF:;DF", f"ESTACAO:;{station.upper()}",
                    f"CODIGO (WMO):;A{len(station)}", "LATITUDE:;-15,78", "LONGITUDE:;-47,92",
                    "ALTITUDE:;1159,54", "DATA DE FUNDACAO:;07/05/2000", HEADER,
                ]
                body = "\r\n".join([*head, *lines["line"]]) + "\r\n"
                archive.writestr(f"2024/{station}_2024.CSV", body.encode("latin-1"))
        first = int(batch["event_id"].iloc[0]) if len(batch) else number
        yield pd.DataFrame({"path": [f"part-{first}/2024.zip"], "content": [held.getvalue()]})


@query("read_zip_archives", STATION_DAY_SQL)
def read_zip_archives(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station"), "event_id", _data_line().alias("line")
    )
    packed = lines.mapInPandas(_pack, "path string, content binary")
    return _station_hours(archives.parse_archives(packed))


def _store_archives(batches, root):
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            store, inner = archives.open_store(f"{root}/{path}")
            store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(inner) as out:
                out.write(content)
        yield batch[["path"]]


@query("read_zip_members", STATION_DAY_SQL)
def read_zip_members(spark, sf_dir):
    """Archives as files, read member by member."""
    root = scratch_path(spark, "archives")
    lines = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station"), "event_id", _data_line().alias("line")
    )
    packed = lines.mapInPandas(_pack, "path string, content binary")
    stored = packed.mapInPandas(partial(_store_archives, root=root), "path string")
    stored.write.format("noop").mode("overwrite").save()
    return _station_hours(archives.read_zip_archives(spark, root))


@query("decode_bytes", "SELECT doc_id, text FROM documents")
def decode_bytes(spark, sf_dir):
    """Texts stored as Latin-1 where that loses nothing, otherwise as UTF-8."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    latin = F.encode(F.translate("text", "’–—…“”„", ""), "ISO-8859-1")
    fits = F.col("text").rlike(r"^[\x00-\xff]*$") & ~F.is_valid_utf8(latin.cast("string"))
    stored = documents.select("doc_id", F.when(fits, latin).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return stored.select("doc_id", text.decode_bytes(F.col("content")).alias("text"))


EVENT_ROW = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("station", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("value", T.FloatType()),
    ]
)


def _event_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("station"), F.year("ts").alias("year"),
        F.col("value").cast("float").alias("value"),
    )


EVENT_ROW_SQL = f"""SELECT event_id, event_type AS station, CAST(year(ts) AS BIGINT) AS "year",
 {t('CAST(value AS FLOAT)')} AS value FROM events"""


def _event_out(df):
    return df.select("event_id", "station", big("year").alias("year"), tidy("value").alias("value"))


@query("csv_gz_round_trip", EVENT_ROW_SQL)
def csv_gz_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    tables.write_csv_gz(_event_rows(spark, sf_dir), path)
    return _event_out(tables.read_typed_csv(spark, path, EVENT_ROW))


@query("parquet_by_year", f"""SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS "year", {t('o_totalprice')} AS o_totalprice
 FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998""")
def parquet_by_year(spark, sf_dir):
    path = scratch_path(spark, "by-year")
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    tables.write_parquet(orders, path)
    years = links.filter_year_range(tables.read_parquet(spark, path), 1996, 1998)
    return years.select("o_orderkey", big("year").alias("year"), tidy("o_totalprice").alias("o_totalprice"))


@query("metrics_json_round_trip", f"""SELECT event_type AS model, 'mean' AS metric, {t('avg(value)')} AS value FROM events GROUP BY 1""")
def metrics_json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    metrics = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.lit("mean").alias("metric"), tidy(F.avg("value")).alias("value")
    )
    tables.write_metrics_json(metrics, path)
    return spark.read.schema(metrics.schema).json(path)


@query("write_if_absent", """SELECT event_type AS station, count(*) AS n_rows FROM events GROUP BY 1""")
def write_if_absent(spark, sf_dir):
    """The second write finds the table and leaves it alone."""
    path = scratch_path(spark, "once")
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("station")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    tables.write_if_absent(counts, path)
    tables.write_if_absent(counts.withColumn("n_rows", F.lit(0).cast("long")), path)
    return spark.read.schema(counts.schema).parquet(path)


@query("incremental_load", """SELECT o_orderkey, o_custkey FROM orders
 WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def incremental_load(spark, sf_dir):
    """Orders whose customer is not among the ones already loaded."""
    loaded = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey")
    )
    orders = table(spark, sf_dir, "orders")
    return tables.only_new(orders, loaded, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("dataset_versions", f"""SELECT name, n_rows, first_ts FROM (
 SELECT 'events' AS name, count(*) AS n_rows, {sql_stamp('min(ts)')} AS first_ts FROM events
 UNION ALL SELECT 'orders', count(*), {sql_stamp('min(o_orderdate)')} FROM orders)""")
def dataset_versions(spark, sf_dir):
    from stationlake.operators.aggregates import dataset_info

    path = scratch_path(spark, "versions")
    for name, ts in (("events", "ts"), ("orders", "o_orderdate")):
        info = dataset_info(table(spark, sf_dir, name), ts).withColumn("name", F.lit(name))
        tables.append_version(info, path)
    versions = spark.read.parquet(path)
    return versions.select("name", F.col("rows").alias("n_rows"), stamp("first_ts").alias("first_ts"))


LINKS_SQL = """l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=["'']([^"'']+)["'']', 1)) AS href FROM pages)"""


@query("extract_links", f"""WITH {LINKS_SQL}
 SELECT page_id, href, CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href
   ELSE regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1) || '/' || regexp_replace(href, '^/+', '') END AS link
 FROM l WHERE ends_with(href, 'n')""")
def extract_links(spark, sf_dir):
    """Pages hold no zip links, so another suffix is asked for."""
    found = links.extract_links(table(spark, sf_dir, "pages"), suffix="n")
    return found.select("page_id", "href", "link")


@query("archive_links", """WITH l AS (SELECT c_custkey, c_name, CAST(1990 + c_nationkey AS BIGINT) AS y FROM customer)
 SELECT c_custkey, 'http://data.example.com/files/' || y || '.zip' AS link, y AS "year" FROM l WHERE y BETWEEN 1995 AND 2005""")
def archive_links(spark, sf_dir):
    """Pages rendered from the customers, with relative links to yearly archives."""
    year = (F.col("c_nationkey") + 1990).cast("string")
    pages = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("http://data.example.com/index").alias("url"),
        F.concat(F.lit('<p><a class="x" href="/files/'), year, F.lit('.zip">'), year,
                 F.lit('</a><a href="/about">about</a></p>')).alias("html"),
    )
    found = links.filter_year_range(links.extract_links(pages), 1995, 2005)
    return found.select("c_custkey", "link", big("year").alias("year"))


@query("filter_year_range", f"""SELECT kind, o_orderkey FROM (
 SELECT 'range' AS kind, o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998
 UNION ALL SELECT 'one', o_orderkey FROM orders WHERE year(o_orderdate) = 1997
 UNION ALL SELECT 'all', o_orderkey FROM orders WHERE o_orderdate IS NOT NULL)""")
def filter_year_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    picks = {
        "range": links.filter_year_range(orders, 1996, 1998),
        "one": links.filter_year_range(orders, 1997),
        "all": links.filter_year_range(orders),
    }
    parts = [df.select(F.lit(kind).alias("kind"), "o_orderkey") for kind, df in picks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- parsing of texts ---

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
RAW_SQL = f"""raw AS (SELECT event_id, event_type, ts, value, k,
  CASE WHEN k < 40 THEN strftime(ts, '%Y/%m/%d') WHEN k < 80 THEN strftime(ts, '%Y-%m-%d')
    WHEN k < 90 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%d.%m.%Y') END AS day_text,
  CASE WHEN k < 30 THEN strftime(ts, '%H:00') WHEN k < 60 THEN strftime(ts, '%H00 UTC')
    WHEN k < 80 THEN CAST(hour(ts) AS VARCHAR) || ':00' WHEN k < 90 THEN CAST(hour(ts) AS VARCHAR)
    ELSE 'none' END AS hour_text,
  CASE WHEN k < 5 THEN 'abc' WHEN k < 10 THEN '' ELSE ' ' || replace(CAST(value AS VARCHAR), '.', ',') END AS number_text
  FROM (SELECT *, {K} AS k FROM events))"""


def raw_texts(spark, sf_dir):
    k = F.col("k")
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(
        "event_id", "event_type", "ts", "value", "k",
        F.when(k < 40, F.date_format("ts", "yyyy/MM/dd")).when(k < 80, F.date_format("ts", "yyyy-MM-dd"))
        .when(k < 90, F.date_format("ts", "yyyy-MM-dd 00:00:00")).otherwise(F.date_format("ts", "dd.MM.yyyy"))
        .alias("day_text"),
        F.when(k < 30, F.date_format("ts", "HH:00")).when(k < 60, F.date_format("ts", "HH00 'UTC'"))
        .when(k < 80, F.concat(F.hour("ts").cast("string"), F.lit(":00")))
        .when(k < 90, F.hour("ts").cast("string")).otherwise("none").alias("hour_text"),
        F.when(k < 5, "abc").when(k < 10, "").otherwise(F.concat(F.lit(" "), _comma("value"))).alias("number_text"),
    )


@query("standard_headers", """SELECT DISTINCT p_type, upper(p_type) || ' TOTAL HORÁRIO MM/C' AS header FROM part""")
def standard_headers(spark, sf_dir):
    headers = table(spark, sf_dir, "part").select(
        "p_type", F.concat(F.lit(" "), F.lower("p_type"), F.lit(" total, horário (mm/ç) ")).alias("raw")
    ).distinct()
    return headers.select("p_type", text.standard_header_column(F.col("raw")).alias("header"))


@query("standardize_column_names", f"""SELECT {t('value')} AS temp_c, event_type AS station, strftime(ts, '%Y-%m-%d') AS obs_date,
 event_id AS "ID" FROM events""")
def standardize_column_names(spark, sf_dir):
    """A raw header with a nameless last column."""
    raw = table(spark, sf_dir, "events").select(
        F.col("value").alias("Temperatura do ar - bulbo seco, horaria (°C)"),
        F.col("event_type").alias("Estação"),
        F.date_format("ts", "yyyy-MM-dd").alias("Data (YYYY-MM-DD)"),
        F.col("event_id").alias("id"),
        F.lit("").alias("Unnamed: 4"),
    )
    named = station_files.standardize_column_names(station_files.drop_unnamed(raw))
    return named.withColumn("temp_c", tidy("temp_c"))


@query("repair_ragged_rows", """WITH l AS (SELECT event_id, event_type AS a, CAST(user_id AS VARCHAR) AS b, CAST(k AS VARCHAR) AS c, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
 SELECT event_id, a AS c1, CASE WHEN k < 20 THEN '' ELSE b END AS c2, CASE WHEN k < 40 THEN '' ELSE c END AS c3,
  CAST(3 AS BIGINT) AS n FROM l""")
def repair_ragged_rows(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    n = k.cast("int")
    line = (
        F.when(n < 20, F.col("event_type"))
        .when(n < 40, F.concat_ws(";", "event_type", F.col("user_id").cast("string")))
        .when(n < 70, F.concat_ws(";", "event_type", F.col("user_id").cast("string"), k))
        .otherwise(F.concat_ws(";", F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("user_id").cast("string"), k, F.lit("x"), F.lit("")))
    )
    rows = table(spark, sf_dir, "events").select(
        "event_id", station_files.repair_ragged(station_files.fields(line), F.lit(3)).alias("r")
    )
    return rows.select(
        "event_id", *[F.col("r")[i].alias(f"c{i + 1}") for i in range(3)], big(F.size("r")).alias("n")
    )


@query("decimal_comma_numbers", f"""WITH {RAW_SQL}
 SELECT event_id, CASE WHEN k >= 10 THEN {t('CAST(value AS FLOAT)')} END AS number, replace(number_text, ',', '.') AS dotted FROM raw""")
def decimal_comma_numbers(spark, sf_dir):
    dotted = text.decimal_comma(F.col("number_text"))
    return raw_texts(spark, sf_dir).select(
        "event_id", tidy(text.number(dotted)).alias("number"), dotted.alias("dotted")
    )


@query("parse_date", f"""WITH {RAW_SQL}
 SELECT event_id, CASE WHEN k < 90 THEN strftime(ts, '%Y-%m-%d') END AS obs_date FROM raw""")
def parse_date(spark, sf_dir):
    day = text.station_date(F.col("day_text"))
    return raw_texts(spark, sf_dir).select("event_id", F.date_format(day, "yyyy-MM-dd").alias("obs_date"))


HOUR_SQL = "CASE WHEN k < 80 OR (k < 90 AND hour(ts) >= 10) THEN CAST(hour(ts) AS BIGINT) END"


@query("parse_hour", f"""WITH {RAW_SQL} SELECT event_id,
 coalesce({HOUR_SQL}, -1) AS obs_hour, CASE WHEN k < 90 THEN CAST(hour(ts) AS BIGINT) ELSE -1 END AS padded_hour FROM raw""")
def parse_hour(spark, sf_dir):
    """An hour that does not parse is shown as -1."""
    strict, padded = text.station_hour(F.col("hour_text")), text.short_hour(F.col("hour_text"))
    return raw_texts(spark, sf_dir).select(
        "event_id", F.coalesce(big(strict), F.lit(-1)).alias("obs_hour"),
        F.coalesce(big(padded), F.lit(-1)).alias("padded_hour"),
    )


@query("build_timestamp", f"""WITH {RAW_SQL} SELECT event_id,
 CASE WHEN k < 90 THEN {sql_stamp("date_trunc('hour', ts)")} END AS ts FROM raw""")
def build_timestamp(spark, sf_dir):
    day, hour = text.station_date(F.col("day_text")), text.short_hour(F.col("hour_text"))
    return raw_texts(spark, sf_dir).select("event_id", stamp(text.reading_time(day, hour)).alias("ts"))


@query("fallback_timestamp", f"""WITH {RAW_SQL} SELECT event_id, CASE WHEN k >= 90 THEN NULL
 WHEN ({HOUR_SQL}) IS NULL THEN {sql_stamp("date_trunc('day', ts)")} ELSE {sql_stamp("date_trunc('hour', ts)")} END AS ts FROM raw""")
def fallback_timestamp(spark, sf_dir):
    day, hour = text.station_date(F.col("day_text")), text.station_hour(F.col("hour_text"))
    ts = text.time_or_date(text.reading_time(day, hour), day)
    return raw_texts(spark, sf_dir).select("event_id", stamp(ts).alias("ts"))


@query("unparsed_hours", f"""WITH {RAW_SQL} SELECT event_type AS station, count(*) FILTER (({HOUR_SQL}) IS NULL) AS unparsed FROM raw GROUP BY 1""")
def unparsed_hours(spark, sf_dir):
    hour = text.station_hour(F.col("hour_text"))
    return raw_texts(spark, sf_dir).groupBy(F.col("event_type").alias("station")).agg(
        F.count_if(F.col("hour_text").isNotNull() & hour.isNull()).alias("unparsed")
    )


@query("parse_preamble", f"""SELECT s_suppkey, s_name AS station, CASE WHEN s_nationkey >= 3 THEN CAST(s_nationkey AS VARCHAR) END AS region,
 {t('CAST(s_acctbal AS FLOAT)')} AS latitude FROM supplier""")
def parse_preamble(spark, sf_dir):
    lines = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("ESTACAO:;"), "s_name").alias("station_line"),
        F.concat(F.lit("REGIAO:;"), F.when(F.col("s_nationkey") >= 3, F.col("s_nationkey").cast("string")).otherwise("")).alias("region_line"),
        F.concat(F.lit("LATITUDE: ;"), _comma("s_acctbal")).alias("latitude_line"),
    )
    latitude = text.number(text.decimal_comma(text.preamble_value(F.col("latitude_line"))))
    return lines.select(
        "s_suppkey", text.preamble_value(F.col("station_line")).alias("station"),
        text.preamble_value(F.col("region_line")).alias("region"), tidy(latitude).alias("latitude"),
    )


PATH_SQL = """'/raw/INMET_CO_' || upper(left(n_name, 2)) || '_A' || s_suppkey || '_' || replace(s_name, '#', ' ') || '_01-01-' || (2000 + s_nationkey) || '_A_31-12-' || (2000 + s_nationkey)"""


def _paths(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    suppliers = attach(table(spark, sf_dir, "supplier"), nations, ["s_nationkey"])
    year = (F.col("s_nationkey") + 2000).cast("string")
    return suppliers.withColumn(
        "path",
        F.concat(
            F.lit("/raw/INMET_CO_"), F.upper(F.substring("n_name", 1, 2)), F.lit("_A"),
            F.col("s_suppkey").cast("string"), F.lit("_"), F.translate("s_name", "#", " "),
            F.lit("_01-01-"), year, F.lit("_A_31-12-"), year, F.lit(".CSV"),
        ),
    )


@query("parse_filename", """SELECT s_suppkey, 'CO' AS region, upper(left(n_name, 2)) AS state, 'A' || s_suppkey AS wmo_code,
 replace(s_name, '#', ' ') AS station FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def parse_filename(spark, sf_dir):
    return _paths(spark, sf_dir).select(
        "s_suppkey", *[text.file_name_part(F.col("path"), p).alias(p) for p in text.FILE_NAME_PARTS]
    )


@query("founded_year", """SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN CAST(1990 + s_nationkey AS BIGINT)
 WHEN s_suppkey % 3 = 1 THEN CAST(CASE WHEN s_suppkey >= 1000 THEN CAST(left(CAST(s_suppkey AS VARCHAR), 4) AS BIGINT)
   ELSE CAST(left(regexp_extract(s_name, '[0-9]{4,}'), 4) AS BIGINT) END AS BIGINT) END, -1) AS founded_year FROM supplier""")
def founded_year(spark, sf_dir):
    """A date, text that is no date, or nothing (shown as -1), by supplier."""
    kind = F.col("s_suppkey") % 3
    value = F.when(kind == 0, F.concat(F.lit("07/05/"), (F.col("s_nationkey") + 1990).cast("string"))).when(
        kind == 1, "unknown"
    ).otherwise("")
    return _paths(spark, sf_dir).select(
        "s_suppkey", F.coalesce(big(text.founded_year(value, F.col("path"))), F.lit(-1)).alias("founded_year")
    )


@query("year_from_filename", """SELECT s_suppkey, CAST(2000 + s_nationkey AS BIGINT) AS "year", CAST(1990 + s_nationkey AS BIGINT) AS inner_year
 FROM supplier""")
def year_from_filename(spark, sf_dir):
    inner = F.concat(F.lit("treated_"), (F.col("s_nationkey") + 1990).cast("string"), F.lit("_part.csv.gz"))
    return _paths(spark, sf_dir).select(
        "s_suppkey", big(text.file_year(F.col("path"))).alias("year"), big(text.file_year(inner)).alias("inner_year")
    )


@query("add_year_drop_founded", """SELECT s_suppkey, CAST(2000 + s_nationkey AS BIGINT) AS "year" FROM supplier""")
def add_year_drop_founded(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("s_suppkey", "path", F.lit(1999).alias("founded_year"))
    return station_files.add_year_drop_founded(rows).drop("path").withColumn("year", big("year"))


@query("standardize_types", f"""WITH {RAW_SQL}
 SELECT CAST(k AS BIGINT) AS obs_hour, event_type AS station, CASE WHEN k >= 10 THEN {t('CAST(value AS FLOAT)')} END AS temp_c,
  CASE WHEN k BETWEEN 40 AND 79 THEN strftime(ts, '%Y-%m-%d') END AS obs_date FROM raw""")
def standardize_types(spark, sf_dir):
    rows = raw_texts(spark, sf_dir).select(
        F.col("k").cast("string").alias("obs_hour"), F.col("event_type").alias("station"),
        text.decimal_comma(F.col("number_text")).alias("temp_c"),
        F.when(F.col("k").between(40, 79), F.col("day_text")).otherwise("soon").alias("obs_date"),
    )
    typed = station_files.standardize_types(rows)
    return typed.select(
        big("obs_hour").alias("obs_hour"), "station", tidy("temp_c").alias("temp_c"),
        F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"),
    )


@query("select_and_drop_columns", "SELECT event_id, event_type AS station FROM events")
def select_and_drop_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("station"), F.hour("ts").alias("obs_hour"), "props"
    )
    kept = station_files.select_columns(rows, ["event_id", "station", "obs_hour", "absent"])
    return station_files.drop_hour(kept)


@query("station_file_rejects", """SELECT event_type AS station, 'no header line' AS reason, count(DISTINCT strftime(ts, '%Y%m%d')) AS files,
 count(*) AS "lines" FROM events WHERE event_type IN ('click', 'view') AND day(ts) % 2 = 0 GROUP BY 1""")
def station_file_rejects(spark, sf_dir):
    """Files whose header is missing or has other words are named, with the lines they hold."""
    lines = table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.lit("files"), "event_type", F.date_format("ts", "yyyyMMdd")).alias("path"),
        "event_type", F.dayofmonth("ts").alias("day"), _data_line().alias("line"),
    )
    bad = F.col("event_type").isin("click", "view") & (F.col("day") % 2 == 0)
    heads = lines.select("path", F.when(~bad, F.lit(HEADER)).otherwise("ESTACAO:;X").alias("line")).distinct()
    found = station_files.rejected_files(heads.union(lines.select("path", "line")))
    return found.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("station"), "reason").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines")
    )


@query("csv_by_name", EVENT_ROW_SQL)
def csv_by_name(spark, sf_dir):
    """Two files whose headers name the columns in different order."""
    path = scratch_path(spark, "csv-by-name")
    rows = _event_rows(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    rows.where(even).write.option("header", "true").csv(path)
    rows.where(~even).select("value", "year", "station", "event_id").write.mode("append").option(
        "header", "true").csv(path)
    return _event_out(tables.read_typed_csv(spark, path, EVENT_ROW))


@query("attach_station_metadata", f"""SELECT l_orderkey, l_linenumber, s_name, {t('s_acctbal')} AS s_acctbal
 FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def attach_station_metadata(spark, sf_dir):
    """Suppliers stand in for stations, their lines for readings."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    stations = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name", tidy("s_acctbal").alias("s_acctbal")
    )
    found = station_files.attach_station_metadata(rows, stations, ["l_suppkey"])
    return found.select("l_orderkey", "l_linenumber", "s_name", "s_acctbal")


@query("number_without_infinities", f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE {t('CAST(value AS FLOAT)')} END AS value FROM events""")
def number_without_infinities(spark, sf_dir):
    """Texts that stand for no finite number are NULL."""
    odd = F.element_at(F.array(*[F.lit(x) for x in ("inf", "-Infinity", "1e999", "NaN")]), (F.col("event_id") % 4 + 1).cast("int"))
    raw = F.when(F.col("event_id") % 3 == 0, odd).otherwise(F.col("value").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", text.number(raw).alias("value"))
    return rows.select("event_id", tidy("value").alias("value"))
