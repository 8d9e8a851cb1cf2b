"""Line de-duplication by site-relative frequency, with DataFrame functions only.

The share of a site's pages that contain a line says whether it is boilerplate. Lines are counted by a hash, so texts
are never shuffled for the counts; what comes back to the pages is, for each site, the few lines over the ratio: at
most the lines of an average page divided by the ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Boilerplate lines up to which the table of sites is broadcast; beyond, it is joined by a shuffle.
BROADCAST_LINES = 200_000
_BLANKS = " \t\r\x0b\x0c"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def boilerplate(docs: DataFrame, *, host: Column, ratio: float, min_pages: int, distinct: bool) -> DataFrame:
    """host and line (a hash): the lines of each site that stand on more than ``ratio`` of its pages."""
    pages = docs.select(host.alias("host"), F.xxhash64(text_of()).alias("page"), F.split(text_of(), "\n", -1).alias("lines"))
    bare = F.array_distinct(F.filter(F.transform("lines", _bare), lambda x: x != ""))
    found = pages.select("host", "page", F.explode(bare).alias("line")).select("host", "page", F.xxhash64("line").alias("line"))
    totals = pages.select("host", "page")
    if distinct:
        found, totals = found.distinct(), totals.distinct()
    counts = found.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = totals.groupBy("host").agg(F.count("*").alias("pages"))
    return counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line")


def line_dedup(docs: DataFrame, *, host: str | Column = "source", ratio: float = 0.1, min_pages: int = 5, distinct: bool = False, report: bool = False) -> DataFrame:
    """``docs`` with the lines dropped from text that stand on more than ``ratio`` of their site's pages.

    A line is what stands between newlines, without blanks at its ends; empty lines stay and are not counted. A page, a
    row of ``docs``, counts a line once. With ``distinct``, pages of one site with equal texts count as one page, so that
    a page that was copied often does not make its own content boilerplate. Lines on fewer than ``min_pages`` pages stay:
    on a small site, two pages with one line are over any ratio by chance. All rows stay, some with an empty text.

    Returns the columns of ``docs`` (n_chars, if there is one, is that of the new text); with ``report`` also n_lines
    and n_dropped, which replace columns of these names. A null text becomes empty, a null host is a site of its own.
    Repeated rows stay. An empty table gives an empty result.
    """
    site = F.coalesce(F.concat(F.lit("="), (F.col(host) if isinstance(host, str) else host).cast("string")), F.lit(""))
    bad = materialize(boilerplate(docs, host=site, ratio=ratio, min_pages=min_pages, distinct=distinct))
    few = bad.count() <= BROADCAST_LINES
    sites = bad.groupBy("host").agg(F.collect_set("line").alias("__lines")).withColumnRenamed("host", "__host")
    pages = docs.withColumn("__site", site)
    pages = pages.join(F.broadcast(sites) if few else sites, F.col("__site") == F.col("__host"), "left")
    lines = F.split(text_of(), "\n", -1)
    kept = F.when(F.col("__lines").isNull(), text_of()).otherwise(F.array_join(F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains("__lines", F.xxhash64(_bare(x)))), "\n"))
    out = pages.withColumn("__kept", kept)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__kept").alias(c))
        elif c == "n_chars":
            columns.append(F.char_length("__kept").cast(docs.schema[c].dataType).alias(c))
        elif not (report and c in ("n_lines", "n_dropped")):
            columns.append(F.col(c))
    if report:
        dropped = F.when(F.col("__lines").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: (_bare(x) != "") & F.array_contains("__lines", F.xxhash64(_bare(x))))))
        columns += [F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped")]
    return out.select(*columns)


#: ``{ratio}``, ``{pages}`` and ``{docs}`` stand for parameters; gives doc_id, the new text, and the other columns.
SQL = """
WITH d AS (SELECT *, coalesce('=' || source, '') AS site, coalesce(text, '') AS t FROM {docs}),
l AS (SELECT site, unnest(list_distinct(list_transform(string_split(t, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))))) AS line FROM d),
n AS (SELECT site, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL),
p AS (SELECT site, count(*) AS pages FROM d GROUP BY ALL),
b AS (SELECT n.site, list(n.line) AS bad FROM n JOIN p ON n.site = p.site WHERE n.n >= {pages} AND n.n > {ratio} * p.pages GROUP BY ALL),
k AS (SELECT d.doc_id, d.lang, d.source, string_split(d.t, chr(10)) AS ls,
             list_filter(string_split(d.t, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) = ''
                         OR NOT list_contains(coalesce(b.bad, []), trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)))) AS ks
      FROM d LEFT JOIN b ON d.site = b.site)
SELECT doc_id, lang, source, array_to_string(ks, chr(10)) AS text, len(ls) AS n_lines, len(ls) - len(ks) AS n_dropped FROM k
"""
