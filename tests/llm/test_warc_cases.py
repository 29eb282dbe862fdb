"""Links, character references and unclosed elements of web pages."""

import time

from pyspark.sql import functions as F

from hearthline.llm import warc_derive


def derived(spark, html):
    pages = spark.createDataFrame([(1, "http://x/", html)], "page_id long, url string, html string")
    return {r.record_type: r.content for r in warc_derive.derive(warc_derive.responses_of(pages)).collect()}


def test_links_in_all_quoting_forms(spark):
    html = """<a href="/o'neil">a</a><a class=k href=/bare>b</a><A HREF='/s"q'>c</A><a data-href="/no">d</a><a\nhref = "/x&amp;y">e</a><a href="">f</a>"""
    found = derived(spark, html)["metadata"]
    links = [line.partition(": ")[2] for line in found.split("\r\n") if line.startswith("outlink")]
    assert links == ["/o'neil", "/bare", '/s"q', "/x&y", ""]


def test_references_are_decoded_once(spark):
    text = derived(spark, "<p>&#38;amp; x &#38;lt; &amp;#38; &#x26;#65; &#65;&lt;</p>")["conversion"]
    assert text == "&amp; x &lt; &#38; &#65; A<"


def test_unclosed_elements_are_read_once(spark):
    table = spark.createDataFrame([("a<script>" * 80000,), ("b<script " * 80000,), ("c<!-- " * 100000,), ("e<style>x</style>f",)], "html string")
    began = time.time()
    got = [r[0] for r in table.select(warc_derive.plain_text(F.col("html"))).collect()]
    assert got[:3] == ["a", "b", "c"] and got[3] == "e f"
    assert time.time() - began < 20
