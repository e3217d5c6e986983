"""Lines that a site repeats on many of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage

#: Shares and counts of the production query.
MAX_RATIO, MIN_PAGES = 0.3, 3

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)(?:[\s/][^>]*)?>"
_TAG = r"<[^>]*>"


def page_text(html: Column) -> Column:
    """Text of a page with a line for each block element; comments, scripts, styles and inline tags go."""
    bare = F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _BLOCK, "\n")
    return F.regexp_replace(bare, _TAG, "")


def host_of(url: Column) -> Column:
    """Host and port of a URL in lower case; null where the URL has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(host != "", host)


def lines_of(text: Column) -> Column:
    """Lines of a text without the space around them and without empty ones; none for null."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def drop_boilerplate(pages: DataFrame, host: str, lines: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of pages with `kept_lines`: their lines without those that too many pages of the host have.

    A line goes if at least `min_pages` pages of the host have it and these are more than `max_ratio` of the host's pages.
    A line counts once for each page. Each host's boilerplate is one row, and its list is bounded: no more than (mean
    distinct lines of a page) / max_ratio lines can pass the ratio. So pages meet a single row of their host, and a host
    with a third of all pages is a skewed join that Spark splits, never a group in one task. Counting has partial sums,
    and lines travel as two hashes, not as text.

    A null host has no site: its pages keep all lines. Null or no lines give an empty list. Repeated rows count as pages
    of their own. An empty table gives no rows. Names that start with `__`, and `kept_lines`, must not be in pages.
    """
    sign = lambda x: F.struct(F.xxhash64(x).alias("a"), F.crc32(x.cast("binary")).alias("b"))
    sites = pages.filter(F.col(host).isNotNull()).select(F.col(host).alias("__host"), F.array_distinct(F.transform(lines, sign)).alias("__signs"))
    # A null sign stands for the page itself, so the host's total comes from the same pass.
    signs = F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), F.col("__signs"))
    counts = sites.select("__host", F.explode(signs).alias("__sign")).groupBy("__host", "__sign").agg(F.count(F.lit(1)).alias("__n"))
    frequent = counts.filter((F.col("__n") >= min_pages) | F.col("__sign").isNull())
    totals = frequent.filter(F.col("__sign").isNull()).select("__host", F.col("__n").alias("__pages"))
    # Written, so that pages meet a plain table: Spark broadcasts it if it is small and splits the hot host if not.
    bad = cut_lineage(
        frequent.filter(F.col("__sign").isNotNull())
        .join(totals, "__host")
        .filter(F.col("__n") > max_ratio * F.col("__pages"))
        .groupBy("__host")
        .agg(F.collect_list("__sign").alias("__bad"))
    )
    joined = pages.join(bad, pages[host] == bad["__host"], "left")
    kept = F.filter(F.col(lines), lambda x: ~F.array_contains(F.col("__bad"), sign(x)))
    return joined.withColumn("kept_lines", F.when(F.col("__bad").isNull(), F.col(lines)).otherwise(kept)).drop("__host", "__bad")


def site_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, url, host, text of the kept lines, lines and dropped lines.

    Null url: host null and every line kept. Null html: no lines and an empty text. Only page_id, url and html are read.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), lines_of(page_text(F.col("html"))).alias("lines"))
    out = drop_boilerplate(rows, "host", "lines", max_ratio, min_pages)
    return out.select(
        "page_id", "url", "host",
        F.array_join("kept_lines", "\n").alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("bigint").alias("n_dropped"),
    )
