"""Line dedup by site-relative frequency: lines on too large a share of a host's pages go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Flagged lines (8 bytes each) that are sent to every executor at most; more are joined by host.
SENT_LINES = 500_000
BREAKS = "(?i)<(/?(p|div|li|ul|ol|h[1-6]|br|hr|nav|article|section|header|footer|main|aside|title|head|body|html|table|tr|td|th|form|option|blockquote|pre)\\b[^>]*)>|\\r?\\n"
DROPPED = "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def host_of(url):  # noqa: ANN001, ANN201
    """The lower-case host of a URL column without user and port; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)", 2), F.lit(""))


def lines_of(html):  # noqa: ANN001, ANN201
    """The text lines of an HTML column: block tags and newlines end a line, other tags go, white space is collapsed, empty lines go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), DROPPED, "\n")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, "[ \\t\\f\\x0B]+", " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def dedup_lines(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3, html_col: str = "html", url_col: str = "url", columns: Sequence[str] | None = None) -> DataFrame:
    """``columns`` of ``pages`` (all, if none are named) with ``host``, ``n_lines``, ``n_dropped`` and ``kept_text``.

    For each host, the pages that contain a line (once a page) are divided by the
    host's pages; lines over ``ratio`` that are on at least ``min_pages`` pages
    are dropped from all its pages, in place; other lines keep their order. Lines
    with equal counts fare alike.

    Html is parsed once; lines are written to the shared folder with the columns
    asked for. Lines are counted by 64-bit hash with partial aggregation, so a
    host with a third of all pages is spread by its lines, and a line on all its
    pages is added up before the shuffle. At most ``mean lines a page / ratio``
    lines of a host can be flagged, so they come as one short array a host; pages
    meet them by host (sent whole if the flagged lines of all hosts are few,
    which is checked; else in a join that adaptive execution can split), and no
    page is taken apart and put together again.

    Null urls, or urls without a host, have no site and keep all lines; null
    html is empty; long pages are whole; repeated rows are pages of their own; an
    empty table gives no rows. Columns of the four names above are replaced.
    """
    rest = [c for c in (pages.columns if columns is None else columns) if c not in ("host", "n_lines", "n_dropped", "kept_text")]
    cut = checkpoint(pages.select(*rest, host_of(F.col(url_col).cast("string")).alias("host"), lines_of(F.col(html_col).cast("string")).alias("__lines")))
    sited = cut.where("host is not null")
    hosts = sited.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = sited.select("host", F.explode(F.array_distinct(F.transform("__lines", lambda x: F.xxhash64(x)))).alias("line"))
    seen = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    flagged = seen.join(hosts, "host").where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("__flagged"))
    flagged = checkpoint(flagged)
    few = flagged.agg(F.coalesce(F.sum(F.size("__flagged") + 8), F.lit(0))).first()[0] <= SENT_LINES
    # pages without a host meet nothing, and must not meet each other in one task
    met = sited.join(F.broadcast(flagged) if few else flagged, "host", "left").select(*rest, "host", "__lines", "__flagged")
    out = met.unionByName(cut.where("host is null").select(*rest, "host", "__lines", F.lit(None).cast("array<long>").alias("__flagged")))
    kept = F.when(F.col("__flagged").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.array_contains(F.col("__flagged"), F.xxhash64(x))))
    out = out.withColumn("__kept", kept)
    return out.select(*rest, "host", F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"), F.array_join("__kept", "\n").alias("kept_text"))


SQL = r"""
WITH cut AS (SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2), '') AS host,
  list_filter(list_transform(string_split(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
    '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g'),
    '(?i)<(/?(p|div|li|ul|ol|h[1-6]|br|hr|nav|article|section|header|footer|main|aside|title|head|body|html|table|tr|td|th|form|option|blockquote|pre)\b[^>]*)>|\r?\n', chr(10), 'g'),
    '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\f\x0B]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
hosts AS (SELECT host, count(*) AS pages FROM cut WHERE host IS NOT NULL GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut WHERE host IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 3),
flagged AS (SELECT host, list(line) AS bad FROM seen JOIN hosts USING (host) WHERE n > 0.3::DOUBLE * pages GROUP BY host),
kept AS (SELECT page_id, cut.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM cut LEFT JOIN flagged ON cut.host = flagged.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM kept
"""
