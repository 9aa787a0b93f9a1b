import datetime as dt
import zipfile

import pytest

from obsframe.sources import archives, html, sinks, stations, tables


def write(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_zonal_table(spark, tmp_path):
    head = "Year," + ",".join(tables.ZONES)
    path = write(tmp_path / "z.csv", f"{head}\n1901,-.12,-.2,-.04,-.3,-.1,.02,-.5,-.4,-.3,-.2,-.1,0,.07,*****\n")
    row = tables.annual_zones(spark, path, "zones").first()
    assert (row["year"], row["ta_global"], row["ta_sfrigid"]) == (1901, -0.12, None)


def test_sunspots(spark, tmp_path):
    path = write(tmp_path / "s.csv", "1818;01;01;1818.001;  -1; -1.0;   0;1\n1818;01;08;1818.021;  65; 10.2;   1;1\n")
    a, b = tables.daily_sunspots(spark, path, "daily").orderBy("date").collect()
    assert (a["sunspots"], a["sunspots_sd"]) == (None, None)
    assert (b["date"], b["sunspots"], b["sunspots_sd"], b["sunspots_observations"]) == (dt.date(1818, 1, 8), 65, 10.2, 1)


def test_monthly_anomalies(spark, tmp_path):
    cells = ",".join(["-.25"] * 13 + ["***", "***"] + ["-.1"] * 3)
    path = write(tmp_path / "m.csv", f"Title line\nYear,Jan,Feb\n1901,{cells}\n")
    row = tables.monthly_anomalies(spark, path).first()
    assert (row["file_name"], row["jan"], row["d_n"], row["djf"], row["son"]) == ("m.csv", -0.25, None, None, -0.1)


def test_commented_annual(spark, tmp_path):
    path = write(tmp_path / "c.txt", "# note\n#\n  1959   315.97     0.12\n  2017   406.53     0.12\n")
    got = {r["year"]: r["co2_global"] for r in tables.commented_annual(spark, path, "obs").collect()}
    assert got == {1959: 315.97, 2017: 406.53}


def test_irradiance(spark, tmp_path):
    body = "".join(f" {d}{n:9.1f}{v:11.4f}\n" for d, n, v in (("781116", -410.5, -99.0), ("031001", 8674.5, 1361.1234)))
    path = write(tmp_path / "i.dat", "; heading\n; 42 lines of prose\n\n" + body)
    a, b = tables.daily_irradiance(spark, path, "sat").orderBy("date").collect()
    assert (a["date"], a["irradiance"]) == (dt.date(1978, 11, 16), None)
    assert (b["date"], b["irradiance"]) == (dt.date(2003, 10, 1), 1361.1234)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r\r\n"])
def test_station_list(spark, tmp_path, end):
    line = "  {:5s} {:<40s}{:9.4f} {:9.4f} {:8s} {:8s} {:6.1f}  {:3d}   {:1s}"
    lines = [
        "Stations measuring rainfall", "", "  Site  Name", "---------- -----",
        line.format("46012", "WILCANNIA", -31.5194, 143.385, "Jan 1879", "Oct 2018", 139.2, 98, "Y"),
        line.format("2012", "HALLS CREEK", -18.2291, 127.6636, "Jan 1944", "Oct 2018", 74.8, 99, " "), "", "2 stations",
    ]
    got = stations.read_stations(spark, write(tmp_path / "l.txt", end.join(lines))).orderBy("station").collect()
    assert [(r["station"], r["name"], r["latitude"], r["longitude"]) for r in got] == [
        ("2012", "HALLS CREEK", -18.2291, 127.6636), ("46012", "WILCANNIA", -31.5194, 143.385),
    ]
    assert (got[1]["years"], got[1]["percent"], got[1]["aws"], got[0]["aws"]) == (139.2, 98, "Y", None)


def test_pre_table(spark, tmp_path):
    def line(year, values):
        cells = [f"{v:.1f}" if v is not None else "" for v in values]
        return f" {year:<8d}" + "".join(c.center(8) for c in cells[:11]) + cells[11].center(7)

    full, part = [1.5 * i - 7 for i in range(12)], [float(-i) for i in range(10)] + [None, None]
    page = f"<html>\n<body>\nText<br>\n<pre>\n Year    Jan     Feb\n{line(1901, full)}\n{line(1902, part)}\n</pre>\n</body>\n</html>"
    rows = html.read_pre_months(spark, write(tmp_path / "p.html", page), "bureau").collect()
    got = {(r["year"], r["month"]): r["soi"] for r in rows}
    assert [got[1901, m] for m in range(1, 13)] == full
    assert [got[1902, m] for m in range(1, 11)] == part[:10] and len(got) == 22


def test_links_by_text_and_block(spark):
    page = '<div id="top"><a href="/a">All years of data</a></div><div id="content-block"><a class="x" href="/b"><b>All years</b> of data</a><a href="/c">Other</a></div>'
    df = spark.createDataFrame([(1, page), (2, "none")], "page_id int, html string")
    got = html.find_links(df, "html", ["page_id"], "All years of data", "content-block").collect()
    assert [(r["page_id"], r["href"]) for r in got] == [(1, "/b")]


def test_boxes(spark, tmp_path):
    path = write(tmp_path / "b.txt", "country        longmin   latmin  longmax   latmax\n AA             -70.983   12.400  -69.850   12.617 \n")
    assert [tuple(r) for r in tables.whitespace_boxes(spark, path).collect()] == [("AA", -70.983, 12.4, -69.85, 12.617)]


def test_centroids_have_all_columns(spark, tmp_path):
    names = tables.CENTROID_COLUMNS
    row = {n: "" for n in names} | {"name": "Aruba", "pop_est": "103065", "Longitude": "-69.98", "Latitude": "12.52"}
    path = write(tmp_path / "c.csv", ",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    got = tables.country_centroids(spark, path).first()
    assert len(names) == 68 and (got["name"], got["pop_est"], got["Latitude"]) == ("Aruba", 103065, 12.52)


@pytest.fixture
def archive_folder(tmp_path):
    head = ",".join(archives.heading(archives.RAINFALL))

    def save(code, member, text):
        with zipfile.ZipFile(tmp_path / archives.RAINFALL.file_of(code), "w") as z:
            z.writestr(member, text)

    save("1001", archives.RAINFALL.member_of("1001"), f"{head}\nIDCJAC0009,1001,2000,02,29,1.5,1,Y\nIDCJAC0009,1001,2000,02,30,2.0,,\nIDCJAC0009,1001,2000,03,01,,,\n")
    save("1002", archives.RAINFALL.member_of("1002"), f"{head}\n")
    save("1003", "other.csv", "x")
    (tmp_path / archives.RAINFALL.file_of("1004")).write_bytes(b"broken")
    return str(tmp_path)


def test_archives_load_and_skip_missing(spark, archive_folder):
    wanted = spark.createDataFrame([("1001",), ("9999",)], "station string")
    rows = archives.load_stations(spark, archive_folder, archives.RAINFALL, wanted, "src").collect()
    got = [(r["station"], r["date"], r["value"], r["measurement_days"]) for r in rows]
    assert got == [("1001", dt.date(2000, 2, 29), 1.5, 1), ("1001", None, 2.0, None), ("1001", dt.date(2000, 3, 1), None, None)]


def test_validation(spark, archive_folder):
    listed = spark.createDataFrame([(s,) for s in ("1001", "1002", "1003", "1004", "1005")], "station string")
    found = archives.validate_archives(listed, archives.list_archives(spark, archive_folder), archives.RAINFALL)
    got = {r["station"]: (r["status"], r["rows"]) for r in found.collect()}
    assert got == {"1001": ("Good", 3), "1002": ("No Data", 0), "1003": ("Read Error", 0), "1004": ("Read Error", 0), "1005": ("Data Missing", 0)}


def test_temperature_archive_names():
    assert archives.MAX_TEMP.file_of("48013") == "IDCJAC0010_48013_1800.zip"
    assert archives.MIN_TEMP.member_of("48013") == "IDCJAC0011_48013_1800_Data.csv"


def test_memo_ignores_an_unfinished_table(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    name = sinks.memo_name("numbers", 2, start=1950, end=2017)
    assert name == "numbers-v2-end=2017-start=1950"
    assert sinks.memoise(spark, str(tmp_path), name, build).count() == 3
    assert sinks.memoise(spark, str(tmp_path), name, build).count() == 3
    assert len(calls) == 1
    (tmp_path / name / "_SUCCESS").unlink()
    sinks.memoise(spark, str(tmp_path), name, build)
    assert len(calls) == 2
    assert sinks.rebuild(spark, str(tmp_path), name, lambda: spark.range(5)).count() == 5
