"""Quality rules: measures of each text by itself, and cross-document line frequency by host."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import WHITE_SPACE, materialise

GAP = r"[\x20\x09-\x0D]+"
#: Within a line: all white space but \n.
GAP_IN_LINE = r"[\x20\x09\x0B-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, though body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column, most: int = 26) -> Column:
    """The sum of all numbers up to each place of an array of up to 2**most: in each round every place adds what lies 1, 2, 4, ... places before it."""

    def round_(at: Column, k: int) -> Column:
        if k == most:
            return at
        further = lambda x: F.transform(x, lambda v, i: v + F.coalesce(F.get(x, i - (1 << k)), F.lit(0)))
        return F.when(F.size(at) <= 1 << k, at).otherwise(let(further(at), lambda x: round_(x, k + 1)))

    return let(numbers, lambda x: round_(x, 0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more in the text."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce((F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["p"]))

    def among(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, lambda s: let(places(s), covered)))

    last = F.size(words) - WINDOW
    return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW))), among))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: F.struct(
            let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE_SPACE)) != ""), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        ),
    )


def normal_lines(text: Column) -> Column:
    """The lines that hold a word, in lower case, with single spaces between words."""
    lines = F.split(F.regexp_replace(F.lower(text), GAP_IN_LINE, " "), "\n", -1)
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def digest(*parts: Column) -> Column:
    """128 bits that stand for the parts' values; a null is no value, and no part runs into the next."""
    framed = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.unhex(F.md5(F.concat(*framed).cast("binary")))


def judge_quality(docs: DataFrame, most_docs: int = 100, share: float = 0.1, small: int = 2, least_words: int = 20, least_share: float = 0.3) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept for every row of docs.

    docs: doc_id, source, text (others are ignored). The measures are those of the text alone (null or empty: no words). A normalised
    line is removed where more than `most_docs` documents of its host (source; null is one) hold it, or more than `share` of them
    and more than `small`: in a host of a few documents every line that two copies hold would be above the share. A document left
    with fewer than `least_words` words or less than `least_share` of them is rejected, beside those that fail by themselves. A
    repeated row is a document of its own; it gets the same row as its copies. A very long text is measured whole within
    its row, its windows of words sorted only if some occur twice; an empty table gives no rows.

    Lines move only as 128-bit digests of host and line with a count; texts never move. The frequent lines are written down
    first, so they are broadcast only if they are known to fit; otherwise their join is one that Spark may split.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", text.alias("text"), digest(F.col("doc_id"), F.col("source"), text).alias("row"))
    hosts = rows.groupBy("source").agg(F.count("*").alias("host_docs")).withColumnRenamed("source", "host")
    key = lambda line: digest(F.col("source"), F.col(line))
    found = rows.select("source", F.explode(F.array_distinct(normal_lines(F.col("text")))).alias("line")).select(key("line").alias("key"))
    frequent = materialise(found.groupBy("key").agg(F.count("*").alias("line_docs")).where(F.col("line_docs") > small))
    all_lines = rows.select("row", "source", F.explode(normal_lines(F.col("text"))).alias("line")).select("row", "source", key("line").alias("key"), F.size(F.split("line", " ")).alias("words"))
    hits = all_lines.join(frequent, "key").groupBy("row", "source", "line_docs").agg(F.sum("words").alias("words"))
    hits = hits.join(hosts, hits.source.eqNullSafe(hosts.host)).where((F.col("line_docs") > most_docs) | (F.col("line_docs") > share * F.col("host_docs")))
    removed = hits.groupBy("row").agg(F.sum("words").alias("removed"))
    measured = rows.select("doc_id", "row", measures(F.col("text")).alias("m")).select("doc_id", "row", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.n_dup_lines", "m.w.n_repeat_words")
    measured = measured.groupBy(*measured.columns).agg(F.count("*").alias("copies"))
    out = measured.join(removed, "row", "left").withColumn("n_removed_words", F.coalesce((F.col("removed") / F.col("copies")).cast("long"), F.lit(0).cast("long")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumns({"base_failed": failed, "kept": ~failed & (left >= least_words) & (left >= least_share * F.col("n_words"))})
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, unnest(range(0, len(w) - 7)) AS p, w FROM t WHERE len(w) >= 8),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p + 1 : p + 8], ' ')) AS n FROM p),
s AS (SELECT r, p, least(8, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 8)) AS step FROM g WHERE n > 1),
x AS (SELECT r, CAST(sum(step) AS BIGINT) AS n FROM s GROUP BY r),
nl AS (SELECT r, source, trim(unnest(string_split(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)))) AS line FROM d),
f AS (SELECT source, line, count(DISTINCT r) AS k FROM nl WHERE line <> '' GROUP BY source, line),
h AS (SELECT source, count(*) AS n FROM d GROUP BY source),
rm AS (SELECT nl.r, CAST(sum(len(string_split(nl.line, ' '))) AS BIGINT) AS n FROM nl JOIN f ON nl.line = f.line AND nl.source IS NOT DISTINCT FROM f.source
       JOIN h ON h.source IS NOT DISTINCT FROM f.source WHERE f.k > 100 OR f.k > 2 AND f.k > 0.1 * h.n GROUP BY nl.r),
b AS (SELECT t.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words, coalesce(rm.n, 0) AS n_removed_words FROM t LEFT JOIN x ON t.r = x.r LEFT JOIN rm ON t.r = rm.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_removed_words,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 20 AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM b
"""
