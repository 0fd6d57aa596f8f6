"""Line dedup by site-relative frequency: a line that too great a share of a host's pages holds is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import WHITE_SPACE, materialise


def line_key(line: Column) -> Column:
    """128 bits that stand for a line: among all lines of a corpus no two share them."""
    return F.unhex(F.md5(line.cast("binary")))


def drop_boilerplate(docs: DataFrame, ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """doc_id, text, n_lines, n_dropped for every row of docs (doc_id, source, text; others are ignored).

    A line (between \\n; white space at its ends doesn't count) is dropped wherever more than `ratio` of its host's pages hold it and
    at least `min_pages` do. Hosts are values of source; null is one. Lines without a word stay. A null text stays null, with 0
    lines; a repeated row is a page of its own.

    Pages move as 64-bit hashes of host and line with a count, combined on the map side. A host has at most (lines a page) /
    ratio boilerplate lines, so they fit in one array beside the host; that table is written down first, and Catalyst
    broadcasts it only if its true size allows, else joins by host in a way that Spark may split.
    """
    rows = docs.select("doc_id", "source", "text")
    lines = lambda text: F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE_SPACE)))
    held = rows.select("source", F.explode(F.array_distinct(F.filter(lines(F.col("text")), lambda x: x != ""))).alias("line"))
    counts = held.groupBy("source", line_key(F.col("line")).alias("key")).agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    hosts = rows.groupBy("source").agg(F.count("*").alias("total")).withColumnRenamed("source", "host")
    frequent = counts.join(hosts, counts.source.eqNullSafe(hosts.host)).where(F.col("pages") > ratio * F.col("total"))
    dropped = materialise(frequent.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys")))
    out = rows.join(dropped, rows.source.eqNullSafe(dropped.host), "left")
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda x: ~F.array_contains(F.coalesce("keys", F.array().cast("array<binary>")), line_key(F.btrim(x, F.lit(WHITE_SPACE)))))
    out = out.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", F.array_join("kept", "\n").alias("text"), "n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"))


BOILERPLATE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
n AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT source, key, count(DISTINCT r) AS k FROM n WHERE key <> '' GROUP BY source, key),
h AS (SELECT source, count(*) AS total FROM d GROUP BY source),
b AS (SELECT f.source, key FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE k >= 5 AND k > 0.05 * total),
m AS (SELECT n.r, n.i, n.line, b.key IS NOT NULL AS boiler FROM n LEFT JOIN b ON n.key = b.key AND n.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE NOT m.boiler), '') END AS text,
       CAST(count(m.i) AS BIGINT) AS n_lines, CAST(count(m.i) FILTER (WHERE m.boiler) AS BIGINT) AS n_dropped
FROM d LEFT JOIN m ON d.r = m.r GROUP BY d.r, d.doc_id, d.text
"""
