"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fresh_names, if_small, written

#: Elements without visible text, and the tags that end a line; both forms are legal in Java's and in RE2's syntax. An element
#: without an end takes the rest, and a tag ends before the next one begins, so that no start is searched for twice.
HIDDEN = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|<head\b.*?(?:</head>|\z)"
BREAKS = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|nav|article|footer|header|table|tr|td|section|br|title|body|html|hr|main|aside|pre|blockquote)\b[^<>]*>"
TAGS = r"<[^<>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def page_text(html: Column) -> Column:
    """Visible text of a page: hidden elements go (one without an end, with all that follows), block tags become line breaks,
    other tags go. A ``<`` that another one follows before any ``>`` is text."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAKS, "\n"), TAGS, "")


def drop_site_lines(
    df: DataFrame, site: Column, text: Column, *, max_ratio: float, min_pages: int, distinct_texts: bool = False, out: str = "text", prefix: str = ""
) -> DataFrame:
    """Drop the lines that appear on more than ``max_ratio`` of their site's pages.

    For each site the pages that contain a line (trimmed, non-blank; counted once a page) are divided by the site's page
    total. With ``distinct_texts`` pages of one site with equal texts count as one page in both, for where whole copies are
    another operator's business. Sites with fewer than ``min_pages`` pages keep all lines. Adds or replaces ``out`` (the lines
    kept, joined by line feeds) and adds ``<prefix>n_lines`` and ``<prefix>n_dropped``.

    Scale: a map-side combined count per (site, line hash) is the only wide step on lines, so a hot site is spread over its
    lines. A site's flagged lines number at most its mean lines a page over ``max_ratio``, whatever its page count, so they
    travel as one short array per site. Page totals and flagged lines are tables of one row a site: they are broadcast up to
    BROADCAST_ROWS sites, so that texts stay where they are; beyond that texts are joined by site, hot sites split.

    Edge cases: a null site keeps all lines; a null text stays null with 0 lines; an empty text has one (blank) line; blank
    lines are never dropped; repeated rows are pages each; texts of any length are read whole; an empty table gives an empty
    one; columns of any other name pass through.
    """
    key, body, lines, flags, left = fresh_names(df, "__site", "__body", "__lines", "__flags", "__kept")
    base = df.withColumn(key, site).withColumn(body, text)
    pages = base.where(F.col(key).isNotNull() & F.col(body).isNotNull())
    distinct = F.array_distinct(F.transform(F.split(F.col(body), "\n"), lambda x: F.trim(x)))
    line = F.explode(F.filter(distinct, lambda x: x != "")).alias("__line")
    if distinct_texts:
        once = pages.select(key, F.xxhash64(body).alias("__page"), line).select(key, F.xxhash64("__line").alias("__line"), "__page").distinct()
        total = pages.select(key, F.xxhash64(body).alias("__page")).distinct()
    else:
        once, total = pages.select(key, line).select(key, F.xxhash64("__line").alias("__line")), pages.select(key)
    total = total.groupBy(key).agg(F.count("*").alias("__total")).where(F.col("__total") >= min_pages)
    per_line = once.groupBy(key, "__line").agg(F.count("*").alias("__n")).where(F.col("__n") > max_ratio * min_pages)
    flagged = (
        per_line.join(if_small(written(total, "totals")), key)
        .where(F.col("__n") > F.lit(max_ratio) * F.col("__total"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("__line")).alias(flags))
    )
    kept = F.filter(F.col(lines), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(flags), F.xxhash64(F.trim(x))))
    return (
        base.join(if_small(written(flagged, "flagged")), key, "left")
        .withColumn(lines, F.split(F.col(body), "\n"))
        .withColumn(left, F.when(F.col(flags).isNull(), F.col(lines)).otherwise(kept))
        .withColumn(out, F.when(F.col(flags).isNull(), F.col(body)).otherwise(F.array_join(left, "\n")))
        .withColumn(f"{prefix}n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn(f"{prefix}n_dropped", F.coalesce(F.size(lines) - F.size(left), F.lit(0)).cast("long"))
        .drop(key, body, lines, flags, left)
    )
