"""Line dedup by site-relative frequency, in DataFrame functions only.

Each page gives its distinct lines as hashes; their counts by (host, line) are summed before the shuffle, and divided by the
host's number of pages. Lines over the ratio go. A host has at most (lines a page) / ratio such lines, so they fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

RATIO, MIN_PAGES = 0.5, 4
#: The same for the sources of documents. A source mixes unlike documents, so a line that one in a hundred texts repeats is boilerplate,
#: if these texts are their own for the rest: over OWN of their characters are on lines that are less frequent.
SOURCE_RATIO, SOURCE_LEAST, OWN = 0.01, 4, 0.5


def host_of(url: Column) -> Column:
    """The host of a URL, lower-case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def text_of(html: Column) -> Column:
    """HTML with each tag as a line break."""
    return F.regexp_replace(html, "<[^>]*>", "\n")


def frequent(lines: DataFrame, hosts: DataFrame, total: int, ratio: float, min_pages: int) -> DataFrame:
    """(host, bad: array of line hashes) for rows (host, line, and copy if copies count once): lines on over `ratio` of the host's
    pages (hosts: host, pages, n as spread_join() takes it) and on at least `min_pages`."""
    n = F.count_distinct("copy") if "copy" in lines.columns else F.count("*")
    found = lines.groupBy("host", "line").agg(n.alias("on")).where(F.col("on") >= min_pages)
    found = c.spread_join(found, hosts, "host", total, by="line").where(F.col("on") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("line").alias("bad"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, own: float | None = None) -> DataFrame:
    """(host, bad, n) for pages (host, lines): the hashes of lines on over `ratio` of the host's pages, and on at least `min_pages`
    of them, and the number of its rows. A line counts once a page; blank lines never count. With a column copy, pages of one
    host and one value of it count as one page.

    With `own`, lines are counted twice, the second time only on pages with over that share of characters on lines that the first
    count did not find. Near copies are made of each other's lines, so they make none of them boilerplate.
    """
    copy = [x for x in pages.columns if x == "copy"]
    distinct = F.array_distinct(F.transform("lines", lambda x: F.when(x != "", F.xxhash64(x))))
    lines = pages.select("host", *copy, F.explode(distinct).alias("line")).where("line is not null")
    hosts = pages.groupBy("host").agg((F.count_distinct("copy") if copy else F.count("*")).alias("pages"), F.count("*").alias("n"))
    total = pages.count()
    bad = frequent(lines, hosts, total, ratio, min_pages).join(hosts.select("host", "n"), "host")
    if own is None:
        return bad
    some = F.filter("lines", lambda x: x != "")
    each = pages.select("host", *copy, F.transform(some, lambda x: F.xxhash64(x)).alias("line"), F.transform(some, F.length).alias("size"))
    each = c.spread_join(each, bad, "host", total).where("bad is not null")
    chars = lambda x: F.aggregate(x, F.lit(0), lambda t, y: t + y)
    free = F.zip_with("line", "size", lambda x, y: F.when(F.array_contains("bad", x), 0).otherwise(y))
    each = each.where(chars(free) > own * chars(F.col("size")))
    again = each.select("host", *copy, F.explode(F.array_distinct(F.filter("line", lambda x: F.array_contains("bad", x)))).alias("line"))
    return frequent(again, hosts, total, ratio, min_pages).join(hosts.select("host", "n"), "host")


def marked(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, own: float | None = None, copies_once: bool = False) -> DataFrame:
    """pages with __line_list (trimmed) and __line_bad (hashes of its host's boilerplate; empty without any).

    A null host counts as the empty one, a null text as no line. Every row stays, repeated ones too; other columns are
    carried along, whatever their names. With copies_once, equal lists of lines of a host count as one page.
    """
    c.prepare(pages.sparkSession)
    rows = pages.withColumn("__line_host", F.coalesce(host, F.lit("")))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    each = rows.select(F.col("__line_host").alias("host"), lines.alias("lines"))
    bad = boilerplate(each.withColumn("copy", F.xxhash64("lines")) if copies_once else each, ratio, min_pages, own)
    bad = bad.select(F.col("host").alias("__line_host"), F.col("bad").alias("__line_bad"), "n")
    rows = c.spread_join(rows, bad, "__line_host", pages.count()).withColumn("__line_list", lines)  # lines are cut anew rather than shuffled beside the text
    return rows.withColumn("__line_bad", F.coalesce("__line_bad", F.array().cast("array<bigint>")))


def kept(lines: str = "__line_list", bad: str = "__line_bad") -> Column:
    """The lines that stay, blank ones as they are."""
    return F.filter(lines, lambda x: ~F.array_contains(F.col(bad), F.xxhash64(x)))


def dedup_documents(docs: DataFrame, ratio: float = SOURCE_RATIO, min_pages: int = SOURCE_LEAST, own: float = OWN) -> DataFrame:
    """documents with the boilerplate lines of their source taken out of text, and n_chars, if there, as of the new text.

    Copies of a text count once, and texts that are mostly made of frequent lines (near copies) don't count at all, so their lines
    stay for the near-dedup stage unless other texts have them. A text without such a line and a null one stay as they are.
    """
    rows = marked(docs, F.col("source"), F.col("text"), ratio, min_pages, own, copies_once=True)
    keep = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("__line_bad"), F.xxhash64(F.trim(x))))
    rows = rows.withColumn("text", F.when(F.size("__line_bad") > 0, F.array_join(keep, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return rows.select(docs.columns)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = c.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = marked(pages, host_of(F.col("url")), text_of(F.col("html")))
    lines = F.filter("__line_list", lambda x: x != "")
    rows = rows.select("page_id", F.col("__line_host").alias("host"), lines.alias("lines"), F.filter(kept(), lambda x: x != "").alias("left"))
    return rows.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"), F.sha2(F.array_join("left", "\n").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host,
    list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS n FROM p GROUP BY 1),
l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY 1, 2),
bad AS (SELECT host, list(line) AS bad FROM l JOIN t USING (host) WHERE l.n >= {MIN_PAGES} AND l.n > {RATIO} * t.n GROUP BY 1),
k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept FROM p LEFT JOIN bad USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""
