"""Projection, filter and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.operators import ranking
from obsframe.plans.binding import KEYS, OBS, READ, STN, observations, readings, stations, table
from obsframe.plans.registry import query


@query("proj_select_rename", f"""WITH {READ} SELECT station AS station_code, date AS observed_on, value AS rainfall FROM readings""")
def select_rename(spark, sf):
    return readings(spark, sf).select(
        F.col("station").alias("station_code"), F.col("date").alias("observed_on"), F.col("value").alias("rainfall")
    )


@query("proj_drop", f"""WITH {STN} SELECT zone, station, latitude, longitude FROM stations""")
def drop(spark, sf):
    return stations(spark, sf).drop("name")


@query("proj_helpers", """SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem""")
def helpers(spark, sf):
    df = table(spark, sf, "lineitem")
    wanted = ["l_quantity", "l_tax"]
    keys = [c for c in df.columns if c.startswith("l_order") or c.startswith("l_line") and c.endswith("number")]
    return df.select(*keys, *wanted)


@query("proj_mutate", f"""WITH {OBS}, y AS (SELECT zone, station, year, count(*) n, count(value) n_present FROM obs GROUP BY ALL)
SELECT zone, station, year, n, n_present, n > 60 AS n_target_met, n_present > 50 AS n_present_target_met,
 (n > 60) AND (n_present > 50) AS year_clean FROM y""")
def mutate(spark, sf):
    yearly = (
        observations(spark, sf).groupBy(*KEYS, F.year("date").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_present"))
    )
    return (
        yearly.withColumn("n_target_met", F.col("n") > 60)
        .withColumn("n_present_target_met", F.col("n_present") > 50)
        .withColumn("year_clean", F.col("n_target_met") & F.col("n_present_target_met"))
    )


@query("proj_dynamic", f"""WITH {OBS} SELECT zone, station, year, CAST(month AS INTEGER) AS month, round(sqrt(coalesce(sum(value),0.0)+0.1),6) AS sqrt_total,
 max(value) AS top FROM obs GROUP BY ALL""")
def dynamic(spark, sf):
    named = {
        "sqrt_total": F.round(F.sqrt(F.coalesce(F.sum("value"), F.lit(0.0)) + 0.1), 6),
        "top": F.max("value"),
    }
    periods = {"year": F.year("date"), "month": F.month("date")}
    return observations(spark, sf).groupBy(*KEYS, *[c.alias(n) for n, c in periods.items()]).agg(
        *[c.alias(n) for n, c in named.items()]
    )


@query("proj_const_provenance", f"""WITH {READ} SELECT 'AUS' AS zone, station, date, value, 'archive' AS value_source FROM readings""")
def const_provenance(spark, sf):
    return readings(spark, sf).select(
        F.lit("AUS").alias("zone"), "station", "date", "value", F.lit("archive").alias("value_source")
    )


@query("flt_cmp", """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_returnflag = 'A' AND l_quantity > 10""")
def cmp(spark, sf):
    df = table(spark, sf, "lineitem")
    day = F.col("l_shipdate")
    return df.where(
        (day >= F.lit("1996-01-01").cast("timestamp_ntz")) & (day < F.lit("1999-01-01").cast("timestamp_ntz"))
        & (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 10)
    ).select("l_orderkey", "l_linenumber", F.to_date(day).alias("date"), "l_quantity")


@query("flt_between", f"""WITH {STN} SELECT zone, station, longitude, latitude FROM stations
WHERE longitude BETWEEN 112 AND 155 AND latitude BETWEEN -44 AND -10""")
def between(spark, sf):
    return stations(spark, sf).where(
        F.col("longitude").between(112, 155) & F.col("latitude").between(-44, -10)
    ).select("zone", "station", "longitude", "latitude")


@query("flt_in", f"""WITH {STN}, {READ} SELECT station, date, value, source FROM readings
WHERE station IN (SELECT station FROM stations WHERE zone IN ('ASIA','EUROPE'))""")
def is_in(spark, sf):
    codes = stations(spark, sf).where(F.col("zone").isin("ASIA", "EUROPE")).select("station")
    return readings(spark, sf).join(codes, "station", "left_semi")


@query("flt_notnull", f"""WITH {READ} SELECT station, date, value, source FROM readings WHERE value IS NOT NULL""")
def notnull(spark, sf):
    return readings(spark, sf).dropna(subset=["value"])


@query("flt_user", """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem
WHERE l_discount >= 0.05 AND l_returnflag <> 'R'""")
def user(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    df = table(spark, sf, "lineitem")
    stages = [
        SQLTransformer(statement="SELECT * FROM __THIS__ WHERE l_discount >= 0.05 AND l_returnflag <> 'R'"),
        SQLTransformer(statement="SELECT *, l_extendedprice * (1 - l_discount) AS net FROM __THIS__"),
        SQLTransformer(statement="SELECT l_orderkey, l_linenumber, net FROM __THIS__"),
    ]
    return Pipeline(stages=stages).fit(df).transform(df)


@query("prj_distinct_keep", """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def distinct_keep(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice"
    )
    return ranking.first_per_key(orders, ["o_custkey"], ["day", "o_orderkey"])


@query("prj_unique", """SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem""")
def unique(spark, sf):
    return table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
