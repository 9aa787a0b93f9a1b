"""Blocks of pages with many tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.sources import html


def test_a_page_is_cut_once_for_all_its_tags(spark):
    assert html.element(F.col("html"), "b")._jc.toString().count("split(") == 1


def test_a_block_of_many_nested_elements_is_whole(spark):
    inner = "".join(f"<DIV><a href='/{i}'>t{i}</a><div></div></DIV>" for i in range(300))
    page = f"<div><div class=x id=b>{inner}</div><a href='/out'>out</a></div>"
    df = spark.createDataFrame([(1, page), (2, "<p>no block</p>"), (3, None)], "k int, html string")
    got = [(r["k"], r["pos"], r["href"], r["text"]) for r in html.find_links(df, "html", ["k"], block="b").collect()]
    assert got == [(1, i, f"/{i}", f"t{i}") for i in range(300)]
