"""Source and sink queries.

The given tables are first written by Spark in each source's own format to the shared
folder, then read back by the reader under test, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from obsframe.plans.binding import (
    ANNUAL, KEYS, OBS, PRICES, READ, SOI, STN, annual_orders, daily_prices, monthly_index, observations, readings,
    stations, table,
)
from obsframe.plans.registry import query
from obsframe.session import scratch_path
from obsframe.sources import archives, html, sinks, tables
from obsframe.sources import stations as station_lists


def write_lines(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    lines.select("value").write.text(path)
    return path


def write_csv(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


@query("src_csv_typed", f"""WITH {ANNUAL} SELECT 'historic' AS co2_source, year, data_mean_global AS co2_global, data_mean_nh AS co2_nhem, data_mean_sh AS co2_shem FROM annual""")
def csv_typed(spark, sf):
    return tables.annual_carbon(spark, write_csv(spark, annual_orders(spark, sf), "carbon"), "historic")


_BANDS = {
    "Glob": "TRUE", "NHem": "o_orderstatus='F'", "SHem": "o_orderstatus='O'", "24N-90N": "o_orderstatus='P'",
    "24S-24N": "o_orderpriority='1-URGENT'", "90S-24S": "o_orderpriority='2-HIGH'", "64N-90N": "o_orderpriority='3-MEDIUM'",
    "44N-64N": "o_orderpriority='4-NOT SPECIFIED'", "24N-44N": "o_orderpriority='5-LOW'", "EQU-24N": "o_totalprice<100000",
    "24S-EQU": "o_totalprice BETWEEN 100000 AND 200000", "44S-24S": "o_totalprice BETWEEN 200000 AND 300000",
    "64S-44S": "o_totalprice BETWEEN 300000 AND 400000", "90S-64S": "o_totalprice>400000",
}


@query("src_csv_sentinel", f"""SELECT 'zones' AS ta_source, CAST(year(o_orderdate) AS INTEGER) AS year, {", ".join(
    f"CASE WHEN count(DISTINCT month(o_orderdate)) FILTER ({c})=12 THEN round(avg(o_totalprice) FILTER ({c}),2) END AS {tables.ZONES[z]}"
    for z, c in _BANDS.items())} FROM orders GROUP BY 2""")
def csv_sentinel(spark, sf):
    """Zones without all twelve months carry the missing mark."""
    price, month = F.col("o_totalprice"), F.month("o_orderdate")

    def cell(condition: str) -> Column:
        hit = F.expr(condition)
        whole = F.size(F.collect_set(F.when(hit, month))) == 12
        return F.when(whole, F.round(F.avg(F.when(hit, price)), 2).cast("string")).otherwise(F.lit("*****"))

    zonal = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("Year")).agg(
        *[cell(c).alias(z) for z, c in _BANDS.items()]
    )
    return tables.annual_zones(spark, write_csv(spark, zonal, "zones"), "zones")


@query("src_csv_delim", f"""WITH {PRICES} SELECT date, n_orders AS sunspots, 'daily' AS sunspots_source, price_sd AS sunspots_sd, n_orders AS sunspots_observations,
 CAST(1 AS INTEGER) AS sunspots_definite FROM prices""")
def csv_delim(spark, sf):
    missing = F.coalesce(F.col("price_sd"), F.lit(-1.0))
    line = F.concat_ws(
        ";", F.date_format("date", "yyyy"), F.date_format("date", "MM"), F.date_format("date", "dd"),
        F.format_string("%.3f", F.year("date") + (F.dayofyear("date") - 0.5) / 365), F.format_string("%5d", "n_orders"),
        missing.cast("string"), F.format_string("%4d", "n_orders"), F.lit("1"),
    )
    path = write_lines(spark, daily_prices(spark, sf).select(line.alias("value")), "sunspots")
    return tables.daily_sunspots(spark, path, "daily")


@query("src_csv_preamble", f"""WITH {SOI} SELECT year, {", ".join(f"max(soi) FILTER (month={i + 1}) AS {m}" for i, m in enumerate(tables.MONTHLY_MEASURES[:12]))},
 CASE WHEN count(*)=12 THEN round(avg(soi),5) END AS j_d,
 {", ".join(f"(SELECT CASE WHEN count(*)={n} THEN round(avg(s.soi),5) END FROM soi s WHERE s.year*12+s.month BETWEEN soi.year*12+{lo} AND soi.year*12+{lo + n - 1}) AS {name}" for name, lo, n in (("d_n", 0, 12), ("djf", 0, 3), ("mam", 3, 3), ("jja", 6, 3), ("son", 9, 3)))}
FROM soi GROUP BY year""")
def csv_preamble(spark, sf):
    index = monthly_index(spark, sf)
    months = [F.max(F.when(F.col("month") == i, F.col("soi"))) for i in range(1, 13)]
    # Five digits: a third or twelfth of a three-digit sum never ends exactly halfway there.
    def season(first: int, n: int) -> Column:
        """The mean of n months from the given one; month 0 is the December before."""
        inside = F.col("month").between(first, first + n - 1)
        return F.when(F.count_if(inside) == n, F.round(F.avg(F.when(inside, F.col("soi"))), 5))

    # A December counts in its own year as month 12 and in the next one as month 0.
    both = index.select("year", "month", "soi").unionAll(index.where("month = 12").select(F.col("year") + 1, F.lit(0), "soi"))
    mean = F.when(F.count_if(F.col("month") > 0) == 12, F.round(F.avg(F.when(F.col("month") > 0, F.col("soi"))), 5))
    seasons = [season(0, 12), season(0, 3), season(3, 3), season(6, 3), season(9, 3)]
    cells = [F.coalesce(c.cast("string"), F.lit("***")) for c in (*months, mean, *seasons)]
    data = both.groupBy("year").agg(F.array(*cells).alias("cells"), F.count_if(F.col("month") > 0).alias("n")).where("n > 0").select(
        F.concat_ws(",", F.col("year").cast("string"), F.array_join("cells", ",")).alias("value")
    )
    top = spark.createDataFrame([("Monthly means",), ("Year,Jan,Feb,Mar,Apr",)], "value string")
    path = write_lines(spark, top.unionByName(data), "monthly")
    return tables.monthly_anomalies(spark, path).drop("file_name")


@query("src_text_comment_fixed", f"""WITH {ANNUAL} SELECT 'observatory' AS co2_source, year, round(data_mean_global/1000,2) AS co2_global FROM annual""")
def text_comment_fixed(spark, sf):
    data = annual_orders(spark, sf).select(
        F.format_string("  %4d%9.2f%9.2f", F.col("year"), F.round(F.col("data_mean_global") / 1000, 2), F.lit(0.12)).alias("value")
    )
    notes = spark.createDataFrame([("# annual means",), ("#",), ("# year     mean      unc",)], "value string")
    return tables.commented_annual(spark, write_lines(spark, notes.unionByName(data), "observatory"), "observatory")


@query("src_text_skip_fixed", f"""WITH {PRICES} SELECT date, CASE WHEN n_orders < 2 THEN NULL ELSE price END AS irradiance, 'satellite' AS irradiance_source FROM prices""")
def text_skip_fixed(spark, sf):
    value = F.when(F.col("n_orders") < 2, F.lit(-99.0)).otherwise(F.col("price"))
    data = daily_prices(spark, sf).select(
        F.format_string(" %s%9.1f%11.4f", F.date_format("date", "yyMMdd"), F.unix_date("date") + F.lit(0.5), value).alias("value")
    )
    prose = spark.createDataFrame([("; composite of several instruments",), ("; yymmdd  day  value",), ("",)], "value string")
    return tables.daily_irradiance(spark, write_lines(spark, prose.unionByName(data), "irradiance"), "satellite")


@query("src_fwf_station_list", """SELECT 'AUS' AS zone, printf('%05d', s_suppkey) AS station, s_name AS name, CAST(-46 + (s_suppkey*17)%38 AS DOUBLE) AS latitude,
 CAST(110 + (s_suppkey*37)%47 AS DOUBLE) AS longitude, 'Jan 1950' AS start_month, 'Dec 2017' AS end_month, 68.0::DOUBLE AS years, CAST(90 AS INTEGER) AS percent, 'Y' AS aws FROM supplier""")
def fwf_station_list(spark, sf):
    listed = stations(spark, sf).select(
        F.format_string(
            "  %05d %-40s%9.4f %9.4f %-8s %-8s %6.1f  %3d   %1s\r", F.col("station").cast("int"), F.col("name"),
            F.col("latitude"), F.col("longitude"), F.lit("Jan 1950"), F.lit("Dec 2017"), F.lit(68.0), F.lit(90), F.lit("Y"),
        ).alias("value")
    )
    frame = spark.createDataFrame(
        [("Stations measuring rainfall\r",), ("  Site  Name  Lat  Lon  Start  End\r",), ("----------  --------- ---------\r",),
         ("\r",), ("101 stations in all\r",)], "value string",
    )
    return station_lists.read_stations(spark, write_lines(spark, frame.unionByName(listed), "list"))


@query("src_html_pre_fwf", """SELECT o_orderpriority AS product, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
 make_date(CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER), 1) AS date, round(avg(o_totalprice)/1000,1) AS soi, 'bureau' AS soi_source FROM orders GROUP BY ALL""")
def html_pre_fwf(spark, sf):
    """One page per product; a page holds one line per calendar year."""
    monthly = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("product"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(F.round(F.avg("o_totalprice") / 1000, 1).alias("soi"))
    cells = [
        F.coalesce(F.lpad(F.max(F.when(F.col("month") == m, F.format_string("%.1f", "soi"))), w, " "), F.lit(" " * w))
        for m, w in zip(range(1, 13), [8] * 11 + [7])
    ]
    lines = monthly.groupBy("product", "year").agg(
        F.concat(F.rpad(F.format_string(" %d", F.first("year")), 9, " "), *cells).alias("line")
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("year", "line"))), lambda r: r["line"])
    page = F.concat(
        F.lit("<html>\n<body>\nindex<br>\n<pre>\n Year    Jan     Feb\n"), F.array_join(ordered, "\n"), F.lit("\n</pre>\n</body>\n</html>")
    )
    pages = lines.groupBy("product").agg(page.alias("html"))
    return html.parse_pre_months(pages, "html", ["product"], "bureau")


@query("src_html_link", r"""WITH a AS (SELECT page_id, string_split(split_part(split_part(html, '<ul>', 2), '</ul>', 1), '<li>') AS items FROM pages),
u AS (SELECT page_id, unnest(range(1, len(items))) AS pos, items FROM a), l AS (SELECT page_id, pos - 1 AS pos, items[pos + 1] AS item FROM u),
p AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, split_part(item, chr(34), 2) AS href, split_part(split_part(item, '>', 2), '<', 1) AS text FROM l)
SELECT * FROM p UNION ALL SELECT page_id, CAST(100 AS INTEGER), '/data', 'All years' FROM pages""")
def html_link(spark, sf):
    """The links of the page's list, marked as a block, and the one link with a text in another block.

    Each page gets an id on its navigation and a second block with links before and after the wanted one.
    """
    marked = F.replace(F.col("html"), F.lit("<nav>"), F.lit("<nav id='menu'>"))
    extra = F.lit("<div id=files><div><a href=/skip>Skip</a></div><a title='x' href='/data'>All <i>years</i></a></div><p><a href='/data'>All years</a></p>")
    pages = table(spark, sf, "pages").select("page_id", F.concat(marked, extra).alias("html"))
    menu = html.find_links(pages, "html", ["page_id"], block="menu")
    data = html.find_links(pages, "html", ["page_id"], text="All years", block="files")
    return menu.unionAll(data.withColumn("pos", F.lit(100)))


def station_lines(obs: DataFrame, product: archives.Product) -> DataFrame:
    """``station``, ``year`` and the ``line`` of each observation in the format of a product's archives."""
    line = F.concat_ws(
        ",", F.lit(product.member.split("_")[0]), F.col("station"), F.date_format("date", "yyyy"), F.date_format("date", "MM"),
        F.date_format("date", "dd"), F.coalesce(F.col("value").cast("string"), F.lit("")), F.col("measurement_days").cast("string"), F.lit("Y"),
    )
    return obs.select("station", F.year("date").alias("year"), line.alias("line"))


def station_archives(spark, sf, product: archives.Product) -> DataFrame:
    """Daily station rows packed into zip archives, kept together by station and year first."""
    lines = station_lines(observations(spark, sf), product).repartition("station", "year").sortWithinPartitions("station")
    return archives.pack_archives(lines.select("station", "line"), product)


@query("src_zip_csv", f"""WITH {OBS} SELECT p.source, 'AUS' AS zone, station, date, value, measurement_days FROM obs, (VALUES ('rainfall'), ('max_temp'), ('min_temp')) p(source)""")
def zip_csv(spark, sf):
    """All three products, beside a broken archive that must give no row."""
    broken = spark.createDataFrame([("1", bytearray(b"no zip at all"))], "station string, content binary")
    out = None
    for product in (archives.RAINFALL, archives.MAX_TEMP, archives.MIN_TEMP):
        part = archives.load_archives(station_archives(spark, sf, product).unionByName(broken), product, product.name)
        out = part if out is None else out.unionByName(part)
    return out


@query("src_multi_station", f"""WITH {OBS} SELECT o.zone, o.station, o.date, o.value, o.measurement_days, o.source FROM obs o JOIN stations s USING (zone, station)
WHERE s.zone IN ('ASIA','EUROPE') AND s.longitude BETWEEN 112 AND 155 AND s.latitude BETWEEN -44 AND -10""")
def multi_station(spark, sf):
    """Land the observations once, then read only the wanted zones and stations."""
    path = scratch_path(spark, "observations")
    sinks.land_observations(observations(spark, sf), path)
    wanted = stations(spark, sf).where(F.col("longitude").between(112, 155) & F.col("latitude").between(-44, -10))
    return sinks.read_landed(spark, path, wanted, zones=["ASIA", "EUROPE"]).select(
        *KEYS, "date", "value", "measurement_days", "source"
    )


def _wide_value(column: str, position: int) -> tuple[str, str]:
    """A value for a column of the wide dimension, in Spark's SQL and in the check's."""
    special = {"FID": "concat('F', n_nationkey)", "name": "n_name", "continent": "r_name", "pop_est": "CAST(n AS INT)", "gdp_md_est": "balance"}
    if column in special:
        return (special[column],) * 2
    if column in tables.CENTROID_INT:
        return (f"CAST(n_nationkey * {position} AS INT)",) * 2
    if column in tables.CENTROID_DOUBLE:
        return (f"CAST(n_nationkey + {position} AS DOUBLE)",) * 2
    if position % 9 == 0:
        return "CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"
    return (f"concat(n_name, ', {column} ', {position})",) * 2


_WIDE = {c: _wide_value(c, n) for n, c in enumerate(tables.CENTROID_COLUMNS)}
_NATIONS = """SELECT n_nationkey, n_name, r_name, count(*) AS n, round(sum(s_acctbal),2) AS balance
FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY n_nationkey, n_name, r_name"""


@query("src_wide_dimension", f"""SELECT {", ".join(f'{sql} AS "{c}"' for c, (_, sql) in _WIDE.items())} FROM ({_NATIONS})""")
def wide_dimension(spark, sf):
    """All 68 columns, with commas and missing values in the text."""
    per_nation = (
        table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("n_nationkey", "n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    )
    wide = per_nation.select(*[F.expr(own).alias(c) for c, (own, _) in _WIDE.items()])
    return tables.country_centroids(spark, write_csv(spark, wide, "centroids"))


@query("src_ws_bbox", f"""WITH {STN} SELECT s_name AS country, min(longitude) AS longmin, min(latitude) AS latmin, max(longitude)+5 AS longmax, max(latitude)+5 AS latmax
FROM stations JOIN supplier ON s_name = name GROUP BY s_name""")
def ws_bbox(spark, sf):
    boxes = stations(spark, sf).groupBy("name").agg(
        F.min("longitude").alias("a"), F.min("latitude").alias("b"), (F.max("longitude") + 5).alias("c"), (F.max("latitude") + 5).alias("d")
    )
    data = boxes.select(F.format_string(" %-20s %8.3f %8.3f %8.3f %8.3f ", "name", "a", "b", "c", "d").alias("value"))
    top = spark.createDataFrame([("country        longmin   latmin  longmax   latmax",)], "value string")
    return tables.whitespace_boxes(spark, write_lines(spark, top.unionByName(data), "boxes"))


# By the last digit of a station: no archive, no zip at all, a damaged stream, a wrong checksum, no data; else good.
_FAULTS = {0: ("Data Missing", ""), 1: ("Read Error", "BadZipFile"), 2: ("Read Error", "error"), 3: ("Read Error", "BadZipFile"), 4: ("No Data", "")}


def _case(field: int, digit: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v[field]}'" for k, v in _FAULTS.items())
    return f"CASE {digit} {whens} ELSE '{'Good' if field == 0 else ''}' END"


def damaged_archives(stations_of: DataFrame, product: archives.Product) -> DataFrame:
    """An archive per station (with ``lines``), broken as its last digit says."""
    digit = F.substring("station", -1, 1)
    code = product.member.split("_")[0]
    own = F.transform(F.sequence(F.lit(1), F.col("lines")), lambda n: F.concat(F.lit(f"{code},"), F.col("station"), F.lit(",2000,01,01,"), n.cast("string"), F.lit(".5,1,Y")))
    rows = stations_of.where(digit != "0").select("station", F.when(digit == "4", "").otherwise(F.array_join(own, "\n")).alias("line"))
    packed = archives.pack_archives(rows, product)
    at = F.instr(F.hex("content"), F.hex(F.lit("Data.csv"))) + 16  # the hexadecimal digits after the first member name: its data
    hexed = F.hex("content")

    def overwritten(start: Column, digits: str) -> Column:
        return F.unhex(F.overlay(hexed, F.lit(digits), start))

    central = F.instr(hexed, "504B0102")  # the checksum stands 16 bytes into the list of members, and 14 into the member
    wrong = F.overlay(F.overlay(hexed, F.lit("DEADBEEF"), central + 32), F.lit("DEADBEEF"), F.lit(29))
    return packed.withColumn("content", F.when(digit == "1", F.encode(F.lit("no zip at all"), "utf-8")).when(digit == "2", overwritten(at, "FF"))
                             .when(digit == "3", F.unhex(wrong)).otherwise(F.col("content")))


@query("src_validate_file", f"""SELECT p.product, CAST(doc_id AS VARCHAR) AS station, {_case(0, "doc_id%10")} AS status, {_case(1, "doc_id%10")} AS error,
 CASE WHEN doc_id%10 >= 5 THEN CASE WHEN doc_id%50=7 THEN 25000 ELSE 1+doc_id%3 END ELSE 0 END::BIGINT AS rows
 FROM documents, (VALUES ('rainfall'), ('max_temp'), ('min_temp')) p(product)""")
def validate_file(spark, sf):
    """Documents are the station list; every product has archives broken in every way, some of them long."""
    listed = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("station"), "doc_id")
    lines = F.when(F.col("doc_id") % 50 == 7, 25_000).otherwise(1 + F.col("doc_id") % 3).cast("int")
    out = None
    for product in (archives.RAINFALL, archives.MAX_TEMP, archives.MIN_TEMP):
        found = damaged_archives(listed.withColumn("lines", lines), product)
        part = archives.validate_archives(listed, found, product).withColumn("product", F.lit(product.name))
        out = part if out is None else out.unionByName(part)
    return out


@query("snk_memoise", f"""WITH {OBS} SELECT zone, station, year, count(*) AS n, count(value) AS n_present, count(*) FILTER (value=0) AS n_zero, count(*) FILTER (value<>0) AS n_nonzero FROM obs GROUP BY ALL""")
def memoise(spark, sf):
    """Computed once; the second request is answered from the saved table."""
    from obsframe.operators.quality import yearly_counts

    folder, name = scratch_path(spark, "memo"), sinks.memo_name("yearly_counts", 1, start=1995, end=2001)
    sinks.memoise(spark, folder, name, lambda: yearly_counts(observations(spark, sf), "value"))

    def unexpected() -> DataFrame:
        raise AssertionError("the saved table was not used")

    return sinks.memoise(spark, folder, name, unexpected)


@query("snk_invalidate", f"""WITH {READ} SELECT station, count(value) AS n_present, max(date) AS last_date FROM readings GROUP BY station""")
def invalidate(spark, sf):
    """A stale table is replaced by a rebuilt one."""
    folder, name = scratch_path(spark, "memo"), sinks.memo_name("present", 1)
    stale = readings(spark, sf).where(F.year("date") < 1997)

    def summary(df: DataFrame) -> DataFrame:
        return df.groupBy("station").agg(F.count("value").alias("n_present"), F.max("date").alias("last_date"))

    sinks.memoise(spark, folder, name, lambda: summary(stale))
    return sinks.rebuild(spark, folder, name, lambda: summary(readings(spark, sf)))


def landed_archives(spark, rows: DataFrame, folder: str, part: str, product: archives.Product = archives.RAINFALL) -> None:
    """A zip file for each station's ``rows`` (station, line), in a folder for the part; a station's file is written anew if it is there."""
    packed = archives.pack_stations(rows, product)
    name = F.concat(F.lit(f"{part}/"), F.format_string(product.file_name.replace("{code}", "%s"), F.col("station")))
    sinks.land_files(packed.select(name.alias("name"), "content"), folder).agg(F.sum("length")).collect()


def refreshed(spark, folder: str, memo: str, product: archives.Product = archives.RAINFALL) -> DataFrame:
    """Readings present and last day of each station, from partial results that are kept by file."""
    def summarise(changed: DataFrame) -> DataFrame:
        rows = archives.load_archives(archives.open_files(spark, folder, changed), product, product.name)
        return rows.groupBy("path", "station").agg(F.count("value").alias("n_present"), F.max("date").alias("last_date"))

    partial = sinks.refresh(spark, memo, "present", archives.list_files(spark, folder), summarise)
    return partial.groupBy("station").agg(F.sum("n_present").alias("n_present"), F.max("last_date").alias("last_date"))


@query("snk_refresh", f"""WITH {OBS} SELECT station, count(value) AS n_present, max(date) AS last_date FROM obs GROUP BY station""")
def refresh(spark, sf):
    """Archives as files: half of the stations get a whole new file, the others a second one; only these are read again."""
    folder, memo = scratch_path(spark, "archives"), scratch_path(spark, "memo")
    lines = station_lines(observations(spark, sf), archives.RAINFALL)
    whole = F.crc32("station") % 2 == 0
    landed_archives(spark, lines.where("year < 1997"), folder, "first")
    refreshed(spark, folder, memo)
    landed_archives(spark, lines.where(whole), folder, "first")
    landed_archives(spark, lines.where(~whole & (F.col("year") >= 1997)), folder, "second")
    return refreshed(spark, folder, memo)
