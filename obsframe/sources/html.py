"""Data held in web pages: fixed-width tables in ``<pre>`` and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.functions import scalar as S


def parse_pre_months(pages: DataFrame, html: str, keys: list[str], source: str) -> DataFrame:
    """A year and twelve months per line (widths 9, 8 x 11, 7); empty cells are left out."""
    text = F.regexp_extract(html, r"(?s)<pre>(.*?)</pre>", 1)
    lines = pages.select(*keys, F.explode(F.split(text, r"\r*\n")).alias("line"))
    starts = [1, *range(10, 10 + 8 * 12, 8)]
    widths = [9, *[8] * 11, 7]
    cells = F.array(*[S.lenient_number(F.substring("line", a, w)) for a, w in zip(starts[1:], widths[1:])])
    rows = lines.select(
        *keys, F.trim(F.substring("line", 1, 9)).try_cast("int").alias("year"), cells.alias("cells")
    ).where("year IS NOT NULL")
    long = rows.select(*keys, "year", F.posexplode("cells").alias("pos", "soi")).where("soi IS NOT NULL")
    month = (F.col("pos") + 1).cast("int")
    return long.select(
        *keys, "year", month.alias("month"), S.safe_date("year", month).alias("date"), "soi", F.lit(source).alias("soi_source")
    )


def read_pre_months(spark: SparkSession, path: str, source: str) -> DataFrame:
    pages = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"))
    return parse_pre_months(pages, "html", [], source)


_VALUE = r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
# The entities that addresses and link texts need most.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, in either kind of quotes or none."""
    pattern = rf"(?is)^<[^>]*?\s{name}\s*=\s*{_VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def element(html: Column, block: str) -> Column:
    """The inside of the element with an id, up to the end tag that belongs to it; empty if there is none."""
    opening = rf"(?is)<([a-z][a-z0-9]*)\b[^>]*?\sid\s*=\s*(?:\"{block}\"|'{block}'|{block}(?=[\s>]))[^>]*>"
    found = F.struct(F.lower(F.regexp_extract(html, opening, 1)).alias("name"), F.regexp_extract(html, opening + r"(.*)", 2).alias("rest"))
    # An array of one, so that the page is searched once and not again for every tag.
    return F.transform(F.array(found), lambda f: F.when(f["name"] != "", _inside(f["name"], f["rest"])).otherwise(F.lit("")))[0]


def _inside(name: Column, rest: Column) -> Column:
    """What stands before the end tag that belongs to an element whose start tag is already gone."""
    # Cut before every tag of that name; the depth after each piece tells where the element ends.
    tag = F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"\b)"))
    start = F.struct(F.lit(1).alias("depth"), F.array().cast("array<string>").alias("text"))

    def step(acc: Column, piece: Column) -> Column:
        lower = F.lower(F.substr(piece, F.lit(1), F.length(name) + 2))
        closes = F.startswith(lower, F.concat(F.lit("</"), name))
        opens = ~closes & F.startswith(lower, F.concat(F.lit("<"), name))
        depth = acc["depth"] + F.when(closes, -1).when(opens, 1).otherwise(0)
        depth = F.when(acc["depth"] <= 0, acc["depth"]).otherwise(depth)
        return F.struct(depth.alias("depth"), F.when(depth > 0, F.concat(acc["text"], F.array(piece))).otherwise(acc["text"]).alias("text"))

    return F.array_join(F.aggregate(F.split(rest, tag), start, step)["text"], "")


def links(html: Column) -> Column:
    """All anchors with an address, as an array of (href, text); tags inside the text go."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), F.lit(1))
    anchors = F.filter(anchors, lambda a: F.rlike(a, F.lit(r"(?is)^<a\s[^>]*?href\s*=")))
    return F.transform(
        anchors,
        lambda a: F.struct(
            unescaped(attribute(a, "href")).alias("href"),
            F.trim(unescaped(F.regexp_replace(a, r"(?s)<[^>]*>", ""))).alias("text"),
        ),
    )


def find_links(pages: DataFrame, html: str, keys: list[str], text: str | None = None, block: str | None = None) -> DataFrame:
    """The links of each page; only those with the given text, only inside the element with the given id."""
    body = F.col(html) if block is None else element(F.col(html), block)
    out = pages.select(*keys, F.posexplode(links(body)).alias("pos", "link")).select(*keys, "pos", "link.href", "link.text")
    return out if text is None else out.where(F.col("text") == text)
