"""N-gram Jaccard join: MinHash banding finds groups of candidates, full n-gram sets verify every pair in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe.llm.common import WORD_START, free_name, materialise, mix, pieces, shingles, small_batches, tidy, word_hashes
from recframe.llm.graph import DEALT, components


#: Shingles of about so many members make a block, if these are fewer than its usual number: that bounds a task's memory.
BLOCK_SHINGLES = 2_000_000


def recall(similarity: float, bands: int, rows: int) -> float:
    """The chance that a pair of this Jaccard similarity shares a band."""
    return 1 - (1 - similarity**rows) ** bands


def choose_bands(similarity: float, target: float = 0.9999, rows: int = 7) -> int:
    """The least number of bands of so many rows that reaches the target recall at the threshold."""
    bands = 1
    while recall(similarity, bands, rows) < target:
        bands += 1
    return bands


def choose_banding(similarity: float, target: float = 0.9999, most_bands: int = 40) -> tuple[int, int]:
    """Bands and rows a band: the most rows (so the fewest pairs below the threshold) with which so many bands reach the target recall at it."""
    rows = 1
    while recall(similarity, most_bands, rows + 1) >= target:
        rows += 1
    return choose_bands(similarity, target, rows), rows


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(77)
    return (r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), r.integers(0, 2**32, n, dtype=np.uint32)


def _sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each row, and their offsets."""
    s, rows = shingles(*[word_hashes(data, at)[i] for i in (0, 3)], n)
    each = [np.unique(s[a:b]) for a, b in zip(rows[:-1], rows[1:])]
    return (np.concatenate(each) if each else s), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def _minima(u: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """MinHash values [rows, count] of non-empty sets, a few thousand elements at a time so that they stay in cache."""
    a, b = _coefficients(count)
    x = (mix(u) >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(at) - 1, count), 0xFFFFFFFF, np.uint32)
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + 32768, "right")) - 1)
        part, starts = x[at[row] : at[end]], at[row:end] - at[row]
        y = np.empty_like(part)
        for k in range(count):
            np.multiply(part, a[k], out=y)
            np.add(y, b[k], out=y)
            out[row:end, k] = np.minimum.reduceat(y, starts)
        row = end
    return out


def _signatures(batches, n: int, bands: int, rows: int):
    """id, sid (digest of the shingle set; null without words), size, band keys."""
    band = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    q = np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        for first, data, at in pieces(batch.column("text")):
            count = len(at) - 1
            u, sat = _sets(data, at, n)
            sizes = np.diff(sat)
            full = sizes > 0
            sid = [xxhash.xxh3_128_digest(u[a:b].tobytes()) if b > a else None for a, b in zip(sat[:-1], sat[1:])]
            keys = np.zeros((count, bands), np.uint64)
            if full.any():
                low = _minima(u, np.concatenate([sat[:-1][full], sat[-1:]]), bands * rows).reshape(-1, bands, rows)
                h = np.broadcast_to(band, low.shape[:2]).copy()
                for j in range(rows):
                    h = mix(h * q + low[:, :, j].astype(np.uint64))
                keys[full] = h
            offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, count),
                    pa.array(sid, pa.binary()),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel().view(np.int64))),
                ],
                ["doc_id", "sid", "size", "bands"],
            )


def _shingle_sets(batches, n: int):
    """sid, part, set of the members whose text still gives the digest they were chosen by."""
    for batch in batches:
        for first, data, at in pieces(batch.column("text")):
            u, sat = _sets(data, at, n)
            wanted = batch.column("sid").slice(first, len(at) - 1).to_pylist()
            keep, sets = [], []
            for i, (a, b) in enumerate(zip(sat[:-1], sat[1:])):
                raw = u[a:b].tobytes()
                if wanted[i] is not None and wanted[i] == xxhash.xxh3_128_digest(raw):
                    keep.append(first + i)
                    sets.append(raw)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("sid"), rows.column("comp"), rows.column("blocks"), rows.column("copies"), pa.array(sets, pa.binary())], ["sid", "comp", "blocks", "copies", "shingles"])


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], by products of 0/1 matrices over slices of the shingles that two sets share."""
    lengths = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    number = np.cumsum(counts > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _verify(table: pa.Table, tenths: int) -> pa.Table:
    """sid, links (documents of other texts), label: within one component or one pair of its blocks, or of a bucket's.

    Links are counted once: pairs across the two blocks, or within the one. label joins what hangs together here.
    """
    sid = table.column("sid").to_pylist()
    first = {}
    for i, s in enumerate(sid):
        first.setdefault(s, i)
    keep = sorted(first.values(), key=lambda i: sid[i])
    sid = [sid[i] for i in keep]
    raw, copies = table.column("shingles"), table.column("copies").to_numpy()[keep]
    sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in keep]
    side = table.column("side").to_numpy()[keep]
    i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
    left, right = (np.flatnonzero(side == i), np.flatnonzero(side == j)) if i != j else (np.arange(len(sid)),) * 2
    size = np.array([len(x) for x in sets], np.int64)
    band = int(table.column("band")[0].as_py())
    fresh = np.ones((len(left), len(right)), bool)
    if band > 0:  # a pair of a bucket is judged in the first band that it shares
        keys = np.array([table.column("bands")[k].as_py() for k in keep], np.int64).reshape(len(keep), -1)
        for b in range(band):
            fresh &= keys[left, b][:, None] != keys[right, b][None, :]
    if fresh.any():
        same = _overlaps(sets, left, right)
        near = fresh & (same * (10 + tenths) >= tenths * (size[left][:, None] + size[right][None, :]))
    else:
        near = np.zeros((len(left), len(right)), bool)
    links, label = np.zeros(len(sid), np.int64), np.arange(len(sid))
    if i == j:
        np.fill_diagonal(near, False)
        links += near @ copies
    else:
        links[left] += near @ copies[right]
        links[right] += near.T @ copies[left]
    while near.size:
        low = np.minimum(label[left], np.where(near, label[right][None, :], len(sid)).min(1))
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, np.where(near, new[left][:, None], len(sid)).min(0))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pa.table({"sid": pa.array(sid, pa.binary()), "links": links, "label": pa.array([sid[k] for k in label], pa.binary())})


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """rows, once for each pair of hash blocks of their group that theirs is in: i and j, with side, its own."""
    dealt = rows.withColumn("side", F.pmod(F.xxhash64("sid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).select("sid", "comp", "copies", "shingles", "side", "i", "j", "key", "band", "bands")


def _classes(docs: DataFrame, similarity: float, n: int, target_recall: float, most_bands: int, block: int, whole_blocks: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, sid, size, deal), members (sid, copies, first_doc, deals) and verified (sid, label, links, first_doc) of those with a candidate."""
    tenths = round(similarity * 10)
    # the joins of bands and of texts are sort-merge joins at every size: their sides grow with the data, and Spark may split hot keys
    bands, band_rows = choose_banding(similarity, target_recall, most_bands)
    small_batches(docs.sparkSession)
    rows = materialise(docs.select("doc_id", "text").mapInArrow(lambda it: tidy(_signatures(it, n, bands, band_rows)), "doc_id long, sid binary, size long, bands array<long>").withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(DEALT))))
    members = materialise(rows.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"), F.collect_set("deal").alias("deals")))
    keys = members.select("sid", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("sid").alias("u"), F.max("sid").alias("v")).where("u != v")
    links = keys.join(hubs.select("key", "u").hint("merge"), "key").where("sid != u").select("u", F.col("sid").alias("v"))
    comp = components(links).select(F.col("node").alias("sid"), F.col("label").alias("comp"))
    comp = comp.join(members.select("sid", "copies", "first_doc", "size"), "sid")
    sizes = comp.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    chosen = materialise(comp.drop("size").join(sizes, "comp"))
    text = docs.select(F.col("doc_id").alias("first_doc"), "text")
    sets = text.join(chosen.hint("merge"), text.first_doc.eqNullSafe(chosen.first_doc)).select("text", "sid", "comp", "blocks", "copies")
    sets = sets.mapInArrow(lambda it: tidy(_shingle_sets(it, n)), "sid binary, comp binary, blocks long, copies long, shingles binary")
    most = bands if whole_blocks is None else whole_blocks
    dealt = _pairs_of_blocks(sets.where(F.col("blocks") <= most).withColumns({"key": F.lit(0).cast("long"), "band": F.lit(-1), "bands": F.lit(None).cast("array<long>")}))
    if not chosen.where(F.col("blocks") > most).isEmpty():
        # a component of more blocks than there are bands is cheaper by bucket: each member moves once a bucket it shares
        keys = chosen.where(F.col("blocks") > most).select("sid").join(members.select("sid", "size", "bands"), "sid")
        keys = keys.select("sid", "size", "bands", F.posexplode("bands").alias("band", "key"))
        shared = keys.groupBy("band", "key").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)).alias("blocks")).where("n > 1").drop("n")
        keys = keys.drop("size").join(shared, ["band", "key"])
        dealt = dealt.unionByName(_pairs_of_blocks(sets.where(F.col("blocks") > most).drop("blocks").join(keys, "sid")))
    found = materialise(dealt.groupBy("comp", "band", "key", "i", "j").applyInArrow(lambda t: _verify(t, tenths), "sid binary, links long, label binary"))
    label = components(found.select(F.col("label").alias("u"), F.col("sid").alias("v")))
    count = found.groupBy("sid").agg(F.sum("links").alias("links"))
    verified = label.join(count, label.node == count.sid).join(members.select(F.col("sid").alias("s"), "first_doc"), F.col("node") == F.col("s"))
    return rows, members, verified.select(F.col("node").alias("sid"), "label", "links", "first_doc")


def jaccard_join(docs: DataFrame, similarity: float = 0.8, n: int = 5, target_recall: float = 0.9999, most_bands: int = 40, block: int = 400, whole_blocks: int | None = None) -> DataFrame:
    """doc_id, copy_id, class_id, n_shingles, n_links for every row of docs (doc_id, text; other columns are ignored).

    Two texts link if the Jaccard similarity of their sets of n-word shingles (words: see WORDS; neither case nor punctuation
    counts; a text of fewer than n words is one shingle) is at least `similarity` (in steps of 0.1). copy_id is the least doc_id with the same
    shingle set, class_id the least doc_id that links lead to, n_links counts the other documents that link, copies included.
    Texts that are null or hold no word link to nothing: their copy_id and class_id are their own doc_id and n_links is 0.
    Repeated rows are copies; a null doc_id never is a least one unless there is no other; a very long text counts with all its
    shingles, and fills a block of its own when it is verified; an empty table gives no rows.

    Method: copies fold into one member by the digest of their shingle set. Bands of MinHash values (as many rows a
    band as `most_bands` bands allow for the target recall at the threshold) are shuffled; each member links to the least one in each of its buckets; components of
    these links hold all candidates. A component's shingle sets meet in one task and all pairs are verified by matrix
    products; a component above `block` members, or BLOCK_SHINGLES, is dealt into hash blocks and each pair of blocks is one task;
    one of more than `whole_blocks` blocks (None: as many as bands) goes by the buckets that its members share instead, these
    dealt into blocks in the same way, so that groups that hang together loosely don't cost their square. No task gets an
    unbounded group and only counts and spanning links leave it, never pairs.
    """
    rows, members, verified = _classes(docs, similarity, n, target_recall, most_bands, block, whole_blocks)
    least = verified.groupBy("label").agg(F.min("first_doc").alias("class_first"))
    verified = verified.join(least, "label").select("sid", "links", "class_first")
    # the few members with candidates are put beside all members before these meet the rows
    known = members.select("sid", "copies", "first_doc", "deals").join(verified, "sid", "left")
    # once for each key that a member's copies are dealt over, so a large group of them doesn't meet in one task
    known = known.withColumn("deal", F.explode("deals")).drop("deals")
    out = rows.where("sid is not null").select("doc_id", "sid", "size", "deal").join(known, ["sid", "deal"], "left")
    out = out.select(
        "doc_id",
        F.col("first_doc").alias("copy_id"),
        F.coalesce("class_first", "first_doc").alias("class_id"),
        F.col("size").alias("n_shingles"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    # texts without a word have no key to be joined by, and would all meet in one task
    alone = rows.where("sid is null").select("doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.col("size").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def _digests(batches, n: int, name: str):
    for batch in batches:
        sid = []
        for _, data, at in pieces(batch.column("text")):
            u, sat = _sets(data, at, n)
            sid += [xxhash.xxh3_128_digest(u[a:b].tobytes()) if b > a else None for a, b in zip(sat[:-1], sat[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sid, pa.binary())], [*batch.schema.names, name])


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, n: int = 5, target_recall: float = 0.9999, most_bands: int = 40, block: int = 400, whole_blocks: int | None = None) -> DataFrame:
    """One row, with all its columns, of each class of jaccard_join: the one with the least doc_id, and of its repeated rows one.

    Texts that are null or hold no word are classes of their own and stay; so an empty table gives no rows.
    """
    _, members, verified = _classes(docs, similarity, n, target_recall, most_bands, block, whole_blocks)
    order = F.struct(F.col("first_doc").isNull(), "first_doc", "sid")
    best = verified.groupBy("label").agg(F.min_by("sid", order).alias("best"))
    gone = verified.join(best, "label").where("sid != best").select("sid")
    stay = members.join(gone, "sid", "left_anti").select("sid", "first_doc").hint("merge")
    name = free_name(docs, "_near_sid")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    marked = docs.mapInArrow(lambda it: tidy(_digests(it, n, name)), schema)
    kept = marked.where(F.col(name).isNotNull()).join(stay, (marked[name] == stay.sid) & marked.doc_id.eqNullSafe(stay.first_doc), "left_semi")
    return kept.dropDuplicates([name]).drop(name).unionByName(docs.where(~F.coalesce(F.col("text").rlike(WORD_START), F.lit(False))))
