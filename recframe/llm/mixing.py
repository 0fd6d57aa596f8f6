"""Mixing sources to target weights: exact block quotas, a multivariate-hypergeometric splitting tree, local shuffles."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recframe.llm.common import free_name, materialise

WEIGHTS = (5, 2, 1)
BUDGET, MOST_EPOCHS = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def place(seed: int) -> Column:
    """A document's place in its source's permutation: 32 bits of a digest of its doc_id (null: of an empty one)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int, prefix: str = "_mix") -> DataFrame:
    """docs with <prefix>_size (words in the text; null: 0) and <prefix>_place; the prefix begins no name of docs."""
    return docs.withColumns({f"{prefix}_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), f"{prefix}_place": place(seed)})


def targets(sizes: list[int], weights: list[int], budget: float = BUDGET, most: float = MOST_EPOCHS) -> list[float]:
    """Shares of budget times all sizes by weight; one that reaches `most` times its size stops there, and the rest share what it leaves."""
    left, goal = budget * sum(sizes), [0.0] * len(sizes)
    # those stop first whose limit is the least for their weight, so one pass in that order settles all
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    weight = sum(weights)
    for i in order:
        goal[i] = min(most * sizes[i], left * weights[i] / weight) if left > 0 else 0.0
        left -= goal[i]
        weight -= weights[i]
    return goal


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks [source, shard]: every node splits its quotas between its halves of the shards by one multivariate-hypergeometric draw.

    Each source's blocks sum to its quota, each shard's to an equal share (within one block a level); a node has its own
    generator, named by its range, so reruns agree.
    """
    out = np.zeros((len(quotas), shards), np.int64)

    def split(own: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = own
            return
        mid = (lo + hi) // 2
        total = int(own.sum())
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, total * (mid - lo) // (hi - lo), method="marginals") if total else own
        split(left, lo, mid)
        split(own - left, mid, hi)

    split(np.array(quotas, np.int64), 0, shards)
    return out


def _table(like: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """Rows as a table whose size Catalyst knows."""
    return materialise(like.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))).coalesce(1))


def plan_mix(sizes: DataFrame, shards: int, seed: int, block_words: int) -> DataFrame:
    """One row a source: source, source_size, target, full (whole epochs), last (place up to which the partial epoch goes), blocks, step, ends.

    sizes has source, _mix_size and _mix_place. The driver gets one row a source, never a document. The partial epoch takes the
    documents before a place in the source's permutation, and those at one later place if that lands nearer; the first is found in four rounds, each of which sums the words of at
    most 256 ranges a source and goes on in the one that the target ends in. ends: for each shard, the end of its run of the
    source's permuted block numbers.
    """
    stats = sizes.groupBy("source").agg(F.sum("_mix_size").alias("n")).collect()
    stats = sorted(stats, key=lambda r: (r["source"] is None, r["source"] or ""))  # by code point, null last
    words, weights = [r["n"] for r in stats], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(stats))]
    goal = targets(words, weights)
    full = [min(MOST_EPOCHS, math.floor(g / n)) if n else 0 for g, n in zip(goal, words)]
    rest = [max(0.0, g - f * n) for g, f, n in zip(goal, full, words)]
    base = _table(sizes, [{"source": r["source"], "number": i, "rest": x} for i, (r, x) in enumerate(zip(stats, rest))], "source string, number int, rest double")
    rows = sizes.join(base, sizes.source.eqNullSafe(base.source)).select("number", "rest", "_mix_size", "_mix_place")
    at = base.select("number", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("words"))
    for shift in (24, 16, 8, 0):
        ranges = (
            rows.join(at.drop("words"), "number")
            .where(F.shiftright("_mix_place", shift + 8) == F.col("prefix"))
            .groupBy("number", "rest", "prefix", "before", F.shiftright("_mix_place", shift).alias("range"))
            .agg(F.sum("_mix_size").alias("words"))
            .withColumn("start", F.col("before") + F.sum("words").over(Window.partitionBy("number").orderBy("range")) - F.col("words"))
        )
        reached = F.when(F.col("start") + F.col("words") > F.col("rest"), F.col("range")).otherwise(F.col("range") + (1 << 40))
        at = ranges.groupBy("number").agg(F.min_by(F.struct(F.col("range").alias("prefix"), F.col("start").alias("before"), "words"), reached).alias("x")).select("number", "x.*")
    found = {r["number"]: r for r in at.collect()}
    last = [found[i]["prefix"] if i in found and x > 0 else 0 for i, x in enumerate(rest)]
    short = [x - found[i]["before"] if i in found and x > 0 else 0.0 for i, x in enumerate(rest)]
    # one place from there on, if its documents bring the source nearer to its target
    cut = _table(sizes, [{"number": i, "last": p, "short": x} for i, (p, x) in enumerate(zip(last, short))], "number int, last long, short double")
    later = rows.join(cut, "number").where(F.col("_mix_place") >= F.col("last")).groupBy("number", "short", "_mix_place").agg(F.sum("_mix_size").alias("words"))
    off = F.abs(F.col("words") - F.col("short"))
    extra = {r["number"]: r["x"]["_mix_place"] for r in later.where(off < F.col("short")).groupBy("number").agg(F.min_by(F.struct("_mix_place"), F.struct(off, "_mix_place")).alias("x")).collect()}
    extra = [extra.get(i, -1) for i in range(len(stats))]
    blocks = [max(1, round(n / block_words)) for n in words]
    quotas = [f * b + (-(-p * b >> 32)) + (e >= 0) for f, b, p, e in zip(full, blocks, last, extra)]
    ends = splitting_tree(quotas, shards, seed).cumsum(1) if stats else []
    step = [next(a for a in range(q * 618 // 1000 + 1, q + 2) if math.gcd(a, q) == 1) if q > 1 else 1 for q in quotas]
    plan = [
        {"source": r["source"], "source_size": r["n"], "target": g, "full": f, "last": p, "extra": x, "blocks": b, "quota": q, "step": a, "ends": e.tolist()}
        for r, g, f, p, x, b, q, a, e in zip(stats, goal, full, last, extra, blocks, quotas, step, ends)
    ]
    return _table(sizes, plan, "source string, source_size long, target double, full int, last long, extra long, blocks long, quota long, step long, ends array<long>")


def _planned(rows: DataFrame, plan: DataFrame, p: str = "_mix") -> DataFrame:
    """rows with their source's plan and the shard of each of their copies in the mix, all under names that begin with p."""
    plan = plan.select(*(F.col(c).alias(f"{p}_plan_{c}") for c in plan.columns))
    own = lambda name: F.col(f"{p}_{name}")
    out = rows.join(plan, F.col("source").eqNullSafe(own("plan_source")))
    is_extra = own("place") == own("plan_extra")
    epochs = own("plan_full") + ((own("place") < own("plan_last")) | is_extra).cast("int")
    block = F.shiftright(own("place") * own("plan_blocks"), 32)
    number = lambda e: F.when(is_extra & (e == own("plan_full")), own("plan_quota") - 1).otherwise(e * own("plan_blocks") + block)
    numbers = F.transform(F.sequence(F.lit(0), own("epochs") - 1), lambda e: F.pmod(number(e) * own("plan_step"), F.greatest(own("plan_quota"), F.lit(1))))
    shard = F.transform(numbers, lambda o: F.size(F.filter(own("plan_ends"), lambda x: x <= o)))
    out = out.withColumn(f"{p}_epochs", F.when(own("size") > 0, epochs).otherwise(0))
    return out.withColumn(f"{p}_shards", F.when(own("epochs") > 0, shard).otherwise(F.array().cast("array<int>")))


def mix_digest(docs: DataFrame, shards: int = 64, seed: int = 11, block_words: int = 50_000) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every row of docs (doc_id, source, text; others are ignored).

    size: words of the text (null: 0). Sources (null is one, the last) weigh 5, 2, 1 in turn and share 1.5 times all sizes, at
    most 2 times their own. taken: size times the document's copies in the mix, 0 to 2. shards: comma-joined shard of each copy.
    Rows of one doc_id stand at one place of the permutation, so repeated rows are taken alike; a null doc_id has a place too; a very
    long text counts all its words, and may make its source miss its target by as many; an empty table gives no rows.
    """
    sizes = materialise(sized(docs.select("doc_id", "source", "text"), seed).select("doc_id", "source", "_mix_size", "_mix_place"))
    out = _planned(sizes, plan_mix(sizes, shards, seed, block_words))
    return out.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_plan_source_size").alias("source_size"), F.col("_mix_plan_target").alias("target"), (F.col("_mix_epochs") * F.col("_mix_size")).cast("long").alias("taken"), F.array_join(F.col("_mix_shards").cast("array<string>"), ",").alias("shards"))


def mix(docs: DataFrame, shards: int = 64, seed: int = 11, block_words: int = 50_000) -> DataFrame:
    """The mix itself: docs' columns for each copy taken, with its shard, dealt by shard and shuffled within it.

    Each row is placed by its source's plan alone, so texts move once, to their shard. Documents without words (null or empty
    texts) aren't taken; repeated rows are taken alike; an empty table gives no rows. The shard is the column `_mix_shard`, with
    more underscores where docs has such a name.
    """
    p = free_name(docs, "_mix")
    rows = sized(docs, seed, p)
    plan = plan_mix(materialise(rows.select("source", F.col(f"{p}_size").alias("_mix_size"), F.col(f"{p}_place").alias("_mix_place"))), shards, seed, block_words)
    copies = _planned(rows, plan, p).select(*docs.columns, F.posexplode(f"{p}_shards").alias(f"{p}_epoch", f"{p}_shard"))
    copies = copies.withColumn(f"{p}_order", F.xxhash64(F.lit(seed), f"{p}_shard", f"{p}_epoch", "doc_id"))
    return copies.repartitionByRange(f"{p}_shard", f"{p}_order").sortWithinPartitions(f"{p}_shard", f"{p}_order").drop(f"{p}_order", f"{p}_epoch")


#: size, source_size and taken by the same permutation; the split over shards draws from a generator that SQL lacks.
TAKEN_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (ARRAY[5, 2, 1])[1 + ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST)) - 1) % 3] AS w FROM d GROUP BY source),
c AS (SELECT *, 1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
l AS (SELECT max(rest / open) FILTER (WHERE rest * w / open <= 2 * n) AS free FROM c),
t AS (SELECT source, n, least(2.0 * n, (SELECT free FROM l) * w) AS target FROM c),
g AS (SELECT source, n, CASE WHEN n > 0 THEN least(2, floor(target / n)) ELSE 0 END AS full, target FROM t),
p AS (SELECT d.source, place, g.target - g.full * g.n AS rest, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY place) - sum(size) AS before, sum(size) AS words
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY d.source, place, rest),
e AS (SELECT source, min(place) AS last, arg_min(rest - before, place) AS short FROM p WHERE before + words > rest GROUP BY source),
x AS (SELECT p.source, arg_min(place, (abs(words - short), place)) FILTER (WHERE abs(words - short) < short) AS extra, min(last) AS last
      FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source WHERE place >= last AND rest > 0 GROUP BY p.source)
SELECT d.doc_id, d.size, g.n AS source_size, CAST(d.size * (g.full + CASE WHEN d.place < x.last OR d.place = x.extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
