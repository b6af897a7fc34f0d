"""Boilerplate lines by their frequency within a site (operator 1). DataFrame functions only.

A line's frequency is the share of its host's pages that contain it; pages of one host with
equal text count as one page, so that copies of a page are no boilerplate. Lines are counted
from (host, line, page) hashes with partial aggregation; those that exceed the ratio are few
(an average page's lines divided by the ratio bound them for each host) and come back to the
pages as one array per host, so pages are never taken apart and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import durable

#: Boilerplate lines that a broadcast may hold (8 bytes each); beyond, the join shuffles.
BROADCAST_LINES = 1_000_000
#: Parts that each host's pages are dealt into where the lines aren't broadcast.
DEALS = 16
RESULTS = ("_host", "_text", "n_lines", "n_dropped")


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), "^[a-z]+://([^/:?#]+)", 1)


def lines_of_html(html: Column) -> Column:
    """The text of a page, a line for each run of text between tags, scripts and styles left out."""
    shown = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n")
    return F.regexp_replace(shown, "<[^>]*>", "\n")


def drop_boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = 0.05, least: int = 3) -> DataFrame:
    """``pages`` with _host, _text (kept lines), n_lines and n_dropped.

    A line goes if at least ``least`` different pages of its host hold it and these are more than
    ``ratio`` of the host's different pages; lines are compared without white space at their ends,
    blank lines stay. Null host: one host of its own, ''. Null text: null, 0 lines; an empty text is
    one blank line; texts of any length are taken whole. All columns and repeated rows are kept; a
    column of ``pages`` with one of the four names is returned as <name>_input. No pages: no rows.
    """
    columns, names = pages.columns, []
    for c in columns:
        while c in RESULTS or c in names or c.endswith("_input") and c in columns and c != columns[len(names)]:
            c += "_input"  # noqa: PLW2901
        names.append(c)
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(host, F.lit("")).alias("host"), text.alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(F.trim(x))))
    each = own.where("text is not null").select("host", F.xxhash64("text").alias("page"), F.explode(lines).alias("line"))
    seen = each.groupBy("host", "line").agg(F.countDistinct("page").alias("holding")).where(F.col("holding") >= least)
    total = own.where("text is not null").groupBy("host").agg(F.countDistinct(F.xxhash64("text")).alias("pages"))
    found = durable(seen.join(total, "host").where(F.col("holding") > ratio * F.col("pages")).groupBy("host").agg(F.array_sort(F.collect_set("line")).alias("bad")))
    if (found.agg(F.sum(F.size("bad"))).first()[0] or 0) <= BROADCAST_LINES:
        joined = own.join(F.broadcast(found), "host", "left")
    else:  # a host's pages are dealt over several tasks, each with the host's lines
        dealt = found.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
        joined = own.withColumn("deal", F.pmod(F.xxhash64("text"), F.lit(DEALS)).cast("int")).join(dealt, ["host", "deal"], "left")
    split, keep = F.split("text", "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains(F.coalesce("bad", F.array().cast("array<bigint>")), F.xxhash64(F.trim(x)))
    return joined.withColumn("kept", F.filter(split, keep)).select(
        *[F.col("row").getField(c).alias(name) for c, name in zip(columns, names, strict=True)],
        F.col("host").alias("_host"),
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("_text"),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(split) - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '') AS host,
         regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS text
  FROM pages),
n AS (SELECT host, count(DISTINCT text) AS pages FROM p GROUP BY host),
l AS (SELECT host, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')))) AS line FROM (SELECT DISTINCT host, text FROM p WHERE text IS NOT NULL)),
d AS (SELECT host, line FROM l JOIN n USING (host) GROUP BY host, line, pages HAVING count(*) >= 3 AND count(*) > 0.05 * pages),
a AS (SELECT host, list(line) AS bad FROM d GROUP BY host),
k AS (SELECT page_id, host, text, string_split(text, chr(10)) AS every,
             list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(bad, []), trim(x, ' '))) AS kept
      FROM p LEFT JOIN a USING (host))
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, coalesce(len(every), 0)::BIGINT AS n_lines,
       coalesce(len(every) - len(kept), 0)::BIGINT AS n_dropped
FROM k
"""
