"""URL filter as a sort-merge range join on reversed-host keys.

The key of a host is its labels in reverse order, each followed by a dot (``www.example.com`` is
``com.example.www.``). The hosts under a rule's host are then the keys that start with the rule's key: an
interval, and the intervals of a set of rules are nested or disjoint. Distinct keys of urls and the starts of
rules are dealt out by ranges of the key and sorted. A sweep over each range keeps the stack of rules that are open: the last rule
started at each nesting depth, as long as its interval has not ended. A range begins with
the rules that were opened before it and are still open there. The rules of a host's stack whose path begins the url's path fit;
the longest (host and path together, then the longer host) decides, and of two equal rules the one that blocks.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the default verdict, as does a
url that no rule fits; rules with a null host, path or verdict do not count; repeated urls are judged each; an empty
table gives no rows; extra columns stay, those named as the outputs are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.llm.frames import free_names
from obsframe.llm.line_runs import LOWER, UPPER
from obsframe.session import pin


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def key_end(key: Column) -> Column:
    """The first key after all that start with this one: the closing dot becomes the next character."""
    return F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit("/"))


def outer_keys(key: Column) -> Column:
    """The keys of the hosts above a host, nearest last."""
    n = F.size(F.split(key, r"\.")) - 2
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.call_function("substring_index", key, F.lit("."), i), F.lit(".")))


def open_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``key`` of ``hosts`` with ``open``, the rules whose interval holds it; ``hosts`` has distinct keys."""
    starts = rules.groupBy("key").agg(F.collect_list(F.struct("path", "host", "verdict")).alias("own"))
    starts = starts.select("key", F.struct(key_end(F.col("key")).alias("end"), "own").alias("entry"), F.size(F.split("key", r"\.")).alias("depth"))
    deepest = starts.agg(F.max("depth")).first()[0]
    if deepest is None:
        return hosts.select("key", F.array().cast("array<struct<path:string,host:string,verdict:string>>").alias("open"))
    points = hosts.select("key", F.lit(None).cast(starts.schema["entry"].dataType).alias("entry"), F.lit(None).cast("int").alias("depth"))
    events = points.unionAll(starts).repartitionByRange("key").withColumn("part", F.spark_partition_id())
    events = pin(events)  # the cuts are sampled: every reader must see the same ones
    lows = events.groupBy("part").agg(F.min("key").alias("low")).where(F.size(F.split("low", r"\.")) > 2)
    carried = lows.select("part", F.explode(outer_keys(F.col("low"))).alias("key")).join(starts, "key").select("key", "entry", "depth", "part")
    sweep = Window.partitionBy("part").orderBy("key", F.col("entry").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    stack = [F.last(F.when(F.col("depth") == d, F.col("entry")), ignorenulls=True).over(sweep) for d in range(2, deepest + 1)]
    swept = events.unionByName(carried).withColumn("stack", F.array(*stack))
    still = F.filter("stack", lambda e: e.isNotNull() & (F.col("key") < e["end"]))
    return swept.where(F.col("entry").isNull()).select("key", F.flatten(F.transform(still, lambda e: e["own"])).alias("open"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` has host, path, verdict."""
    known = [F.col(c).isNotNull() for c in ("host", "path", "verdict")]
    rules = rules.where(reduce(Column.__and__, known)).select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    rules = rules.withColumn("key", host_key(F.col("host")))
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    key, open_key, opened, best = free_names(names, "_key", "_open_key", "_open", "_best")
    judged = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))}).withColumn(key, host_key(F.col("host")))
    found = open_rules(judged.select(F.col(key).alias("key")).distinct(), rules)
    found = found.select(F.col("key").alias(open_key), F.col("open").alias(opened))
    fitting = F.filter(opened, lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fitting, lambda r: F.struct(
        (F.length(r["host"]) + F.length(r["path"])).alias("length"), F.length(r["host"]).alias("host_length"),
        r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"),
    ))
    return (
        judged.join(found, F.col(key) == F.col(open_key), "left").withColumn(best, F.array_max(ranked))
        .withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))})
        .drop(key, open_key, opened, best)
    )
