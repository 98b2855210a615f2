"""Site-relative line deduplication of web pages, on DataFrame functions alone.

A line is boilerplate of a host when the pages of that host that contain it, divided by all pages of the
host, reach a ratio. Counting shuffles a hash per distinct line of a page, after map-side sums. A host
with on average m distinct lines a page has at most m / ratio such lines, so they fit one row per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.llm.common import result, saved, shared_dir

RATIO, MIN_PAGES, SALTS, BROADCAST_LINES = 0.3, 3, 16, 500_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
# an element that is never closed reaches to the end, so text is passed once however many openers it has
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<title\b.*?(?:</title\s*>|\z)"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
TAGS = r"</?[A-Za-z!][^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """Visible lines: block elements and line feeds part them, tags go, blanks are trimmed, none is empty."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " "), BREAKS, "\n"), TAGS, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.array_remove(F.split(text, r"[ \t\r\f\x0B]*\n[ \t\r\f\x0B\n]*|^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$"), "")


def drop_boilerplate(pages: DataFrame, id_col: str = "page_id", host: Column | None = None, lines: Column | None = None, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of pages: id, host, n_lines, n_dropped, clean_text (kept lines, joined by line feeds).

    host and lines default to those of the columns url and html. Every row counts as a page, repeated
    rows too; a line repeated on one page counts once. A line goes when at least ``min_pages`` pages of
    its host contain it and their share reaches ``ratio``. Pages without a host keep all lines; a null
    text has none and an empty clean_text. Comments and elements that are never closed reach to the end of
    the page. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    work = shared_dir(spark)
    host = host_of(F.col("url")) if host is None else host
    lines = html_lines(F.col("html")) if lines is None else lines
    rows = saved(pages.select(F.col(id_col).alias("id"), host.alias("host"), lines.alias("lines")), f"{work}/lines")
    known = rows.where("host is not null")
    seen = known.select("host", F.explode(F.transform(F.array_distinct("lines"), lambda x: F.xxhash64(x))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("c"))
    total = known.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # the join by host comes after the sums; a hot host's lines are parted by AQE, its total is one row
    often = seen.where(F.col("c") >= min_pages).join(total, "host").where(F.col("c") >= F.col("pages") * F.lit(ratio))
    often = saved(often.groupBy("host").agg(F.collect_set("line").alias("often")), f"{work}/often")
    if (often.agg(F.sum(F.size("often"))).first()[0] or 0) <= BROADCAST_LINES:  # 8 bytes each
        both = rows.join(F.broadcast(often), "host", "left")
    else:
        salted = often.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.size("lines")), F.lit(SALTS)).cast("int"))
        both = rows.join(salted, ["host", "salt"], "left")
    # a page's own boilerplate is found by hashing; each line is then held against those few
    bad = F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), F.coalesce("often", F.array().cast("array<bigint>")))
    both = both.withColumn("bad", bad)
    kept = F.when(F.size("bad") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("bad", F.xxhash64(x))))
    out = both.withColumn("kept", kept).select(
        F.col("id").alias(id_col), "host", F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.array_join("kept", "\n").alias("clean_text"),
    )
    return result(out, work)
