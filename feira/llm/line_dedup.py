"""Line dedup by frequency within a site.

A page contains a line once however often it repeats it. For each host, the
pages that contain a line are divided by all pages of the host; lines beyond
``ratio`` that are on at least ``least_pages`` pages are boilerplate, and every
occurrence of them on the host's pages is dropped.

Lines are compared without the white space around them and by two 64-bit
hashes; blank lines always stay. A host has at most (distinct lines per page) / ratio boilerplate
lines, however many pages it has, so they travel as one small row per host. A null host is a
host of its own, a null text stays null. Rows that repeat count as pages of their own. Only
DataFrame functions are used: lines are counted where they are read, and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import store

RATIO = 0.1
LEAST_PAGES = 3

SPACE = " \t\n\v\f\r"


def bare(line: Column) -> Column:
    """A line without the white space around it."""
    return F.btrim(line, F.lit(SPACE))


def _lines(body: Column) -> Column:
    return F.split(body, "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(df: DataFrame, host: Column, body: Column, ratio: float, least_pages: int) -> DataFrame:
    """``host, bad``: the boilerplate lines of each host that has any, as an array of keys."""
    pages = df.select(host.alias("host"), body.alias("body"))
    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.filter(F.transform(_lines(F.col("body")), bare), lambda line: line != "")
    common = (
        pages.select("host", F.explode(F.array_distinct(F.transform(lines, _key))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_pages)
    )
    same = common["host"].eqNullSafe(counts["host"])
    return (
        common.join(counts, same)
        .where(common["n"] > ratio * counts["pages"])
        .groupBy(common["host"])
        .agg(F.collect_list(common["line"]).alias("bad"))
    )


def drop_boilerplate(
    df: DataFrame, text_col: str, host: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """The rows of ``df`` with boilerplate lines taken out of ``text_col``; rows and other columns stay as they are."""
    names = df.columns
    folder = store.scratch(df.sparkSession, "lines")
    bad = store.stored(boilerplate(df, host, F.col(text_col), ratio, least_pages), f"{folder}/bad")
    # renamed by place, so that no column of df can clash
    inner = df.select(host.alias("host"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"))
    joined = inner.join(bad.select(F.col("host").alias("bad_host"), "bad"), F.col("host").eqNullSafe(F.col("bad_host")), "left")
    at = names.index(text_col)
    body = F.col(f"row.c{at}")
    kept = F.filter(_lines(body), lambda line: (bare(line) == "") | ~F.array_contains(F.col("bad"), _key(bare(line))))
    cleaned = F.when(F.col("bad").isNull(), body).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *((cleaned if i == at else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names))
    )


def host_of(url: Column) -> Column:
    """The host name of a URL in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: HTML elements that begin or end a line of text.
BLOCKS = "article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul"


def page_text(html: Column) -> Column:
    """The visible text of a page, a line per block element."""
    hidden = "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->"
    breaks = f"(?i)</?(?:{'|'.join(BLOCKS.split())})\\b[^>]*>"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, hidden, ""), breaks, "\n"), "<[^>]+>", "")
