"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions import scalar as S
from obsframe.plans.binding import READ, readings, table
from obsframe.plans.registry import query


@query("fn_string", """SELECT s_suppkey, substr(s_name,1,8) AS head, trim('  ' || s_name || ' ') AS trimmed, split_part(s_name,'#',2) AS code,
 'Station_' || split_part(s_name,'#',2) || '.zip' AS file_name, printf('%03d-%s', s_nationkey, s_name) AS label FROM supplier""")
def string(spark, sf):
    name = F.col("s_name")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.substring(name, 1, 8).alias("head"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.split(name, "#")[1].alias("code"),
        F.concat(F.lit("Station_"), F.split(name, "#")[1], F.lit(".zip")).alias("file_name"),
        F.format_string("%03d-%s", F.col("s_nationkey"), name).alias("label"),
    )


@query("fn_cast", """SELECT c_custkey, TRY_CAST(split_part(c_name,'#',2) AS INTEGER) AS code, TRY_CAST(c_name AS DOUBLE) AS not_a_number,
 TRY_CAST(CASE WHEN c_acctbal < 0 THEN '*****' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS balance,
 TRY_CAST(regexp_replace(c_name, '[^0-9.-]', '', 'g') AS DOUBLE) AS lenient FROM customer""")
def cast(spark, sf):
    name, bal = F.col("c_name"), F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", S.to_int(F.split(name, "#")[1]).alias("code"), S.to_double(name).alias("not_a_number"),
        S.to_double(F.when(bal < 0, F.lit("*****")).otherwise(bal.cast("string"))).alias("balance"),
        S.lenient_number(name).alias("lenient"),
    )


@query("fn_date_parts", f"""WITH {READ} SELECT station, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(dayofyear(date) AS INTEGER) AS doy FROM readings""")
def date_parts(spark, sf):
    return readings(spark, sf).select(
        "station", "date", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofyear("date").alias("doy")
    )


@query("fn_make_date", """SELECT l_orderkey, l_linenumber, TRY_CAST(printf('%04d-%02d-%02d', year(l_shipdate), month(l_shipdate), CAST(l_quantity AS INTEGER)) AS DATE) AS made
FROM lineitem""")
def make_date(spark, sf):
    """Day numbers run to 50, so many do not exist and must come back as NULL."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        S.safe_date(F.year("l_shipdate"), F.month("l_shipdate"), F.col("l_quantity")).alias("made"),
    )


@query("yy_date", f"""WITH {READ} SELECT station, date, strftime(date, '%y%m%d') AS yymmdd, date AS parsed FROM readings""")
def yy_date(spark, sf):
    df = readings(spark, sf).select("station", "date", F.date_format("date", "yyMMdd").alias("yymmdd"))
    return df.withColumn("parsed", S.century_date("yymmdd"))


@query("fn_date_num", f"""WITH {READ}, f AS (SELECT min(date) AS d0 FROM readings)
SELECT station, date, CAST(date - DATE '1970-01-01' AS INTEGER) AS day_number, CAST(date - d0 AS INTEGER) AS series_day,
 CAST(DATE '1970-01-01' + CAST(date - DATE '1970-01-01' AS INTEGER) AS DATE) AS back FROM readings, f""")
def date_num(spark, sf):
    df = readings(spark, sf).select("station", "date")
    first = df.agg(F.min("date").alias("d0")).scalar()
    return df.select(
        "station", "date", F.unix_date("date").alias("day_number"), F.datediff("date", first).alias("series_day"),
        F.date_from_unix_date(F.unix_date("date")).alias("back"),
    )


@query("fn_decade", f"""WITH {READ} SELECT station, date, CAST(floor(year(date)/10)*10 AS INTEGER) AS decade FROM readings""")
def decade(spark, sf):
    return readings(spark, sf).select("station", "date", S.decade(F.year("date")).alias("decade"))


@query("fn_math", """SELECT l_orderkey, l_linenumber, CAST(floor(l_tax*100/3) AS BIGINT) AS floored, CAST(ceil(l_quantity/2) AS BIGINT) AS ceiled,
 round(sqrt(l_quantity+0.1),6) AS rooted, round(ln(l_quantity),6) AS logged, round(log2(l_quantity),6) AS logged2, abs(l_quantity-25) AS distance FROM lineitem""")
def math(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(F.col("l_tax") * 100 / 3).alias("floored"), F.ceil(q / 2).alias("ceiled"),
        F.round(F.sqrt(q + 0.1), 6).alias("rooted"), F.round(F.ln(q), 6).alias("logged"),
        F.round(F.log2(q), 6).alias("logged2"), F.abs(q - 25).alias("distance"),
    )


@query("fn_conditional", f"""WITH {READ} SELECT station, date, CASE WHEN value <> 0 THEN value END AS nonzero, coalesce(value, -1) AS filled,
 CASE source WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'none' END AS source_name FROM readings""")
def conditional(spark, sf):
    return readings(spark, sf).select(
        "station", "date", S.null_if("value", 0.0).alias("nonzero"), F.coalesce("value", F.lit(-1.0)).alias("filled"),
        F.when(F.col("source") == "A", "accepted").when(F.col("source") == "R", "returned").otherwise("none").alias("source_name"),
    )


COUNTS = """c AS (SELECT station, CAST(year(date) AS INTEGER) AS year, count(*) AS n, count(value) AS n_present, count(*)-count(value) AS n_na,
 count(*) FILTER (value=0) AS n_zero FROM readings GROUP BY ALL)"""


def _counts(spark, sf):
    return readings(spark, sf).groupBy("station", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_present"),
        F.count_if(F.col("value").isNull()).alias("n_na"), F.count_if(F.col("value") == 0).alias("n_zero"),
    )


@query("fn_pct", f"""WITH {READ}, {COUNTS} SELECT station, year, round(n/365.0*100,6) AS n_pct, round(n_na/n::DOUBLE*100,6) AS na_pct,
 round(n_zero/nullif(n_present,0)::DOUBLE*100,6) AS zero_pct FROM c""")
def pct(spark, sf):
    return _counts(spark, sf).select(
        "station", "year", F.round(S.percent("n", F.lit(365)), 6).alias("n_pct"),
        F.round(S.percent("n_na", "n"), 6).alias("na_pct"), F.round(S.percent("n_zero", "n_present"), 6).alias("zero_pct"),
    )


@query("fn_ratio_present", f"""WITH {READ}, {COUNTS} SELECT station, year, round(n_present/n::DOUBLE,6) AS present_ratio FROM c""")
def ratio_present(spark, sf):
    return _counts(spark, sf).select("station", "year", F.round(S.ratio("n_present", "n"), 6).alias("present_ratio"))


@query("fn_period_index", f"""WITH {READ} SELECT DISTINCT station, CAST((year(date)-1996)*12+month(date) AS INTEGER) AS baseline_period FROM readings WHERE year(date) BETWEEN 1996 AND 1998""")
def period_index(spark, sf):
    return readings(spark, sf).where(S.in_years("date", 1996, 1998)).select(
        "station", S.period_index(F.year("date"), F.month("date"), 1996).alias("baseline_period")
    ).distinct()


@query("fn_array", f"""WITH {READ}, y AS (SELECT station, min(year(date)) AS y0, max(year(date)) AS y1 FROM readings GROUP BY station)
SELECT station, CAST(y1-y0+1 AS INTEGER) AS n_years, CAST(y0 AS INTEGER) AS first_element, CAST((y0+y1)*(y1-y0+1)/2 AS BIGINT) AS total, CAST(y1 - 1 AS INTEGER) AS replaced_last FROM y""")
def array(spark, sf):
    spans = readings(spark, sf).groupBy("station").agg(
        F.sequence(F.min(F.year("date")), F.max(F.year("date"))).alias("years")
    )
    changed = F.transform("years", lambda y, i: F.when(i == F.size("years") - 1, y - 1).otherwise(y))
    return spans.select(
        "station", F.size("years").alias("n_years"), F.element_at("years", 1).alias("first_element"),
        F.aggregate("years", F.lit(0).cast("bigint"), lambda a, y: a + y).alias("total"),
        F.element_at(changed, -1).alias("replaced_last"),
    )
