"""Line dedup by site-relative frequency: lines that many pages of one host share are boilerplate.

The text blocks of a page are its lines. For each host, the pages that contain a line are divided by the host's pages;
lines above a ratio are dropped from all pages of the host, others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.session import staged

#: A line goes from a host's pages if more than this part of them has it, and at least so many pages: the only line of its
#: kind on a host of one to three pages is no boilerplate.
RATIO, LEAST_PAGES = 0.3, 2
#: Elements whose content is no text, and elements that end a line.
NO_TEXT = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>"
LINE_END = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|table|nav|article|footer|header|title|head|body|section|html)(?: [^>]*)?/?>"
TAG = r"<[^>]*>"
ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"


def host(url: str = "url") -> Column:
    """The host of an address in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def lines_of_html(html: str = "html") -> Column:
    """The page's lines in order: blocks without mark-up, blanks trimmed, empty ones left out."""
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), NO_TEXT, "")
    text = F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, ENDS, "")), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, key: str, site: Column, lines: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(key, host, lines, n_lines, n_dropped) of every row: the lines that stay, in order.

    A line that a page repeats counts once for the page. Rows with one key, repeated or null, are pages of their own.
    Null sites are the site ''. An empty table gives no rows.

    Lines are counted by a 128-bit digest, within tasks first, so a line on a third of all pages meets as a few rows.
    Only lines that go, at most lines-per-page / ratio of each host, are kept, as one array a host.
    """
    rows = staged(pages.select(F.col(key), F.coalesce(site, F.lit("")).alias("host"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines")))
    marks = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.unhex(F.md5(x))))).alias("line"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = marks.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    common = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    gone = staged(common.groupBy("host").agg(F.collect_list("line").alias("gone")))
    # The written table has a known size: below the session's bound it is broadcast, else a hot host's pages are split.
    met = rows.join(gone, "host", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<binary>")))
    stays = F.filter("lines", lambda x: ~F.array_contains("gone", F.unhex(F.md5(x))))
    out = met.select(key, "host", stays.alias("kept"), F.size("lines").alias("n_lines"))
    return out.select(key, "host", F.col("kept").alias("lines"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


ORACLE = rf"""
  WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{NO_TEXT}', '', 'g'), '{LINE_END}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)), lambda x: regexp_replace(x, '{ENDS}', '', 'g')), lambda x: x <> '') AS lines FROM pages),
  l AS (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM p), t AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
  g AS (SELECT host, list(line) AS gone FROM (SELECT host, line, count(*) AS n FROM l GROUP BY ALL) JOIN t USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages GROUP BY 1),
  k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM p LEFT JOIN g USING (host))
  SELECT page_id, host, array_to_string(kept, chr(10)) AS text, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped FROM k"""
