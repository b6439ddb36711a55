"""Fixture files for readers and sinks."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stationlake.functions import text
from stationlake.operators.quality import require_columns, require_rows
from stationlake.sources import archives, links, station_files, tables

PREAMBLE = [
    "REGIÃO:;CO", "UF:;DF", "ESTAÇÃO:;STATION ONE", "CODIGO (WMO):;A001", "LATITUDE:;-15,78",
    "LONGITUDE:;-47,92", "ALTITUDE:;1159,54", "DATA DE FUNDAÇÃO:;07/05/2000",
]
OLD_HEADER = (
    "DATA (YYYY-MM-DD);HORA (UTC);PRECIPITAÇÃO TOTAL, HORÁRIO (mm);"
    "TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);UMIDADE RELATIVA DO AR, HORARIA (%);"
)
NEW_HEADER = OLD_HEADER.replace("DATA (YYYY-MM-DD);HORA (UTC)", "Data;Hora UTC")


def station_file(header=OLD_HEADER, rows=(), preamble=PREAMBLE):
    return "\n".join([*preamble, header, *rows]) + "\n"


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    (raw / "sub").mkdir(parents=True)
    name = "INMET_{}_{}_{}_{}_01-01-{}_A_31-12-{}.CSV"
    (raw / name.format("CO", "DF", "A001", "STATION ONE", 2013, 2013)).write_bytes(
        station_file(
            rows=[
                "2013-01-01;00:00;0,2;21,4;88;",
                "2013-01-01;01:00;-9999;;87;",
                "2013-01-01;02:00;1,0",
                '2013-01-01;03:00;"1,5";20,0;90;extra;more',
            ]
        ).encode("utf-8")
    )
    empty_region = [p if not p.startswith("REGI") else "REGIAO:;" for p in PREAMBLE]
    empty_region = [p if "FUNDA" not in p else "DATA DE FUNDACAO:;soon" for p in empty_region]
    (raw / "sub" / name.format("NE", "BA", "B002", "STATION TWO", 2019, 2019)).write_bytes(
        station_file(
            NEW_HEADER, ["2019/01/01;0000 UTC;,4;25,1;60;", "2019/01/01;1300 UTC;x;26;61;"], empty_region
        ).encode("latin-1")
    )
    (raw / name.format("S", "RS", "C003", "EMPTY", 2020, 2020)).write_bytes(
        station_file().encode("latin-1")
    )
    return str(raw)


def test_read_station_files(spark, folder):
    rows = {
        (r.wmo_code, r.year, r.obs_hour): r
        for r in station_files.read_station_files(spark, folder).collect()
    }
    assert len(rows) == 6
    first = rows[("A001", 2013, 0)]
    assert (first.region, first.state, first.station, first.founded_year) == ("CO", "DF", "STATION ONE", 2000)
    assert first.precip_mm == pytest.approx(0.2) and first.temp_c == pytest.approx(21.4)
    assert first.latitude == pytest.approx(-15.78) and first.altitude == pytest.approx(1159.54)
    assert str(first.ts) == "2013-01-01 00:00:00"
    assert rows[("A001", 2013, 1)].precip_mm == -9999 and rows[("A001", 2013, 1)].temp_c is None
    short, long = rows[("A001", 2013, 2)], rows[("A001", 2013, 3)]
    assert short.temp_c is None and short.humidity is None and short.precip_mm == 1.0
    assert long.precip_mm == 1.5 and long.humidity == 90.0
    newer = rows[("A001", 2019, 13)]
    assert newer.region == "NE" and newer.founded_year == 2019
    assert newer.precip_mm is None and newer.temp_c == 26.0


def test_read_zip_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "2013.zip", "w") as z:
        z.writestr("2013/", "")
        z.writestr("2013/a.CSV", station_file(rows=["2013-01-01;00:00;0,2;21,4;88;"]).encode("latin-1"))
        z.writestr("b.csv", station_file(rows=["2013-01-01;05:00;0,4;22,4;80;"] * 3).encode("utf-8"))
        z.writestr("notes.txt", "no station file")
    rows = archives.read_zip_archives(spark, str(tmp_path)).collect()
    assert sorted(r.obs_hour for r in rows) == [0, 5, 5, 5]
    assert {r.year for r in rows} == {2013} and {r.station for r in rows} == {"STATION ONE"}


def test_one_task_per_member_and_no_whole_archive(spark, tmp_path, monkeypatch):
    text = station_file(rows=["2013-01-01;00:00;0,2;21,4;88;"] * 50).encode("latin-1")
    (tmp_path / "sub").mkdir()
    for year, names in (("2013", ["a.CSV", "sub/b.csv", "c.csv"]), ("sub/2014", ["d.csv"]), ("2015", [])):
        with zipfile.ZipFile(tmp_path / f"{year}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("big.bin", bytes(range(256)) * 4000)
            for name in names:
                z.writestr(name, text)
    lines = archives.member_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == 4
    assert lines.select("member").distinct().count() == 4 and lines.count() == 4 * 59
    rows = archives.read_zip_archives(spark, f"file://{tmp_path}")
    assert sorted((r.year, r["count"]) for r in rows.groupBy("year").count().collect()) == [(2013, 150), (2014, 50)]

    # a reader takes the directory and one member from the file
    (member,) = [m for m in archives.ZipMemberReader([str(tmp_path)]).partitions() if m.member == "d.csv"]
    taken, store = [], archives.open_store

    class Counted:
        def __init__(self, file):
            self.file = file

        def __getattr__(self, name):
            return getattr(self.file, name)

        def read(self, n=-1):
            found = self.file.read(n) if n >= 0 else self.file.read()
            taken.append(len(found))
            return found

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    class Store:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, path):
            return Counted(self.inner.open_input_file(path))

    monkeypatch.setattr(archives, "open_store", lambda p: (Store(store(p)[0]), store(p)[1]))
    assert sum(b.num_rows for b in archives.ZipMemberReader([]).read(member)) == 59
    assert sum(taken) < 20_000


def test_stores_only_spark_can_read():
    assert archives.scheme_of("viewfs://in/x") not in archives.RANGE_STORES
    with pytest.raises(ValueError, match="viewfs"):
        archives.open_store("viewfs://in/x")


def test_large_member_is_cut_into_batches(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(archives, "LINES_PER_BATCH", 4)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.csv", "\r\n".join(str(i) for i in range(10)))
    batch = pd.DataFrame({"path": ["x/2013.zip"], "content": [held.getvalue()]})
    out = list(archives._lines(iter([batch])))
    assert [len(b) for b in out] == [4, 4, 2]
    assert b"".join(b"".join(b["line"]) for b in out) == b"0123456789"


def test_fields_with_quotes(spark):
    lines = ['a;b', 'a;"b;c";d', '"x ""y""";', '', ';;', '"q"']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, line string")
    got = [r.f for r in df.select("i", station_files.fields(F.col("line")).alias("f")).orderBy("i").collect()]
    assert got == [["a", "b"], ["a", "b;c", "d"], ['x "y"', ""], [""], ["", "", ""], ["q"]]


def test_typed_csv_gz(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt", encoding="utf-8") as f:
        f.write("temp_c,station,year\n21.5,ONE,2013\nbad,TWO,2014\n,THREE,x\n")
    df = tables.read_typed_csv(spark, str(tmp_path), "temp_c float, station string, year int")
    rows = {r.station: (r.temp_c, r.year) for r in df.collect()}
    assert rows == {"ONE": (21.5, 2013), "TWO": (None, 2014), "THREE": (None, None)}


def test_typed_csv_with_a_quoted_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b, x",c\n1,2,3\n')
    (tmp_path / "b.csv").write_text('"b",c,a\n5,6,4\n')
    df = tables.read_typed_csv(spark, str(tmp_path), "a int, b int, c int")
    assert sorted(tuple(r) for r in df.collect()) == [(1, None, 3), (4, 5, 6)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 2013)], "station string, x double, year int")
    tables.write_csv_gz(df, str(tmp_path / "csv"))
    assert list((tmp_path / "csv").glob("*.csv.gz"))
    tables.write_parquet(df, str(tmp_path / "pq"))
    assert (tmp_path / "pq" / "year=2013").is_dir()
    tables.write_if_absent(df, str(tmp_path / "once"))
    tables.write_if_absent(df.limit(0), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 1
    tables.write_metrics_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


@pytest.mark.parametrize(
    "raw,hour,padded",
    [("13:00", 13, 13), ("0000 UTC", 0, 0), ("7:00", 7, 7), ("7", None, 7), ("1300", 13, 13),
     ("none", None, None), (None, None, None), ("x:00", None, None)],
)
def test_hours(spark, raw, hour, padded):
    df = spark.createDataFrame([(raw,)], "h string")
    row = df.select(text.station_hour(F.col("h")).alias("a"), text.short_hour(F.col("h")).alias("b")).first()
    assert (row.a, row.b) == (hour, padded)


def test_dates_and_numbers(spark):
    df = spark.createDataFrame(
        [("2019/01/02", "1,5"), ("2019-01-02 00:00:00", " 2 "), ("02.01.2019", "NaN"), (None, "x")],
        "d string, n string",
    )
    rows = df.select(
        text.station_date(F.col("d")).cast("string").alias("d"),
        text.number(text.decimal_comma(F.col("n"))).alias("n"),
    ).collect()
    assert [r.d for r in rows] == ["2019-01-02", "2019-01-02", None, None]
    assert [r.n for r in rows] == [1.5, 2.0, None, None]


def test_required_columns_and_rows(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="temp_c"):
        require_columns(df, ["id", "temp_c"])
    with pytest.raises(ValueError, match="no data"):
        require_rows(df.filter("id > 5"))


def test_zip_links(spark):
    html = '<a href="/a/2013.zip">x</a><a class="y" href="http://h.org/2014.zip">z</a><a href="p.html">p</a>'
    df = spark.createDataFrame([("http://site.org/i/", html)], "url string, html string")
    got = {(r.link, r.year) for r in links.extract_links(df).collect()}
    assert got == {("http://site.org/a/2013.zip", 2013), ("http://h.org/2014.zip", 2014)}
