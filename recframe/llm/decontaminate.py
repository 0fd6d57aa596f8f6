"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recframe.llm.common import pieces, shingles, small_batches, tidy, word_hashes

N = 5
#: Items, and bytes of their texts, in one pass over the documents; a larger benchmark takes several, so what the driver and a task hold is
#: bounded: the multi-index takes about 2 KB an item, the probes 40 bytes a word.
BLOCK, BLOCK_BYTES = 16384, 8 << 20
BLOCKS, BLOCK_BITS = 4, 16


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _running(h: np.ndarray, kind: type) -> np.ndarray:
    """Sums of the bits of all shingles before each one, as 64 counters side by side in 64-bit integers.

    Counters run over into their neighbours, but the difference of two rows, taken as integers, is exact in every counter as
    long as `kind` holds it.
    """
    lanes = np.unpackbits(h.view(np.uint8), bitorder="little").astype(kind, copy=False).view(np.uint64).reshape(len(h), -1)
    total = np.zeros((lanes.shape[1], len(h) + 1), np.uint64)
    np.cumsum(lanes.T, axis=1, out=total[:, 1:])
    return np.ascontiguousarray(total.T)


def simhash(h: np.ndarray) -> int:
    """A bit is set where more than half of the shingles (each as often as it occurs) set it."""
    return int.from_bytes(np.packbits(_bits(h).sum(0) * 2 > len(h), bitorder="little").tobytes(), "little")


def _masks(within: int) -> np.ndarray:
    """All 16-bit words with at most so many bits."""
    return np.array([sum(1 << b for b in c) for k in range(within + 1) for c in combinations(range(BLOCK_BITS), k)], np.int64)


class Size:
    """The items whose windows have one size: fingerprints, and for each 16-bit block the items within its share of the radius.

    If two fingerprints differ in at most `radius` bits, one of their four blocks differs in at most radius // 4; so the union
    of the blocks' postings holds every item within the radius.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], length: int, radius: int):
        self.length, self.radius = length, radius
        self.items = np.array([i for i, _ in items])
        self.prints = np.array([simhash(h) for _, h in items], np.uint64)
        masks = _masks(radius // BLOCKS)
        parts = self.prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.int64)
        self.flag = np.zeros(1 << BLOCK_BITS, np.uint8)  # bit b: some item has this value, or one near it, in block b
        self.first, self.posted = [], []
        for b in range(BLOCKS):
            values = (parts[:, b][:, None] ^ masks).ravel()
            owner = np.repeat(np.arange(len(items)), len(masks))
            order = np.argsort(values, kind="stable")
            self.posted.append(owner[order].astype(np.int32))
            self.first.append(np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32))
            self.flag[values] |= np.uint8(1 << b)

    def near(self, prints: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (of those that are ok) and items within the radius of each other."""
        parts = prints.view(np.uint16).reshape(-1, BLOCKS)
        flags = np.take(self.flag, prints.view(np.uint16))
        some = np.flatnonzero((flags.view(np.uint32) & np.uint32(0x08040201) != 0) & ok)
        flags = flags.reshape(-1, BLOCKS)[some]
        windows, items = [], []
        for b in range(BLOCKS):
            at = some[flags[:, b] >> np.uint8(b) & np.uint8(1) != 0]
            if not len(at):
                continue
            lo, hi = self.first[b][parts[at, b]], self.first[b][parts[at, b].astype(np.int64) + 1]
            n = hi - lo
            window = np.repeat(at, n)
            item = self.posted[b][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            windows.append(window[close])
            items.append(item[close])
        if not windows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(windows), np.concatenate(items)], 1), axis=0)
        return pairs[:, 0], self.items[pairs[:, 1]]


class Probes:
    """The exact route: of each item so many shingles that every window at the threshold holds one of them.

    A window of at most the m shingles of an item is `least` similar only if both share o >= least * m of them (a window that the
    document's end cuts off may hold just those), so any m - o + 1 of the item's shingles (each as often as it occurs) meet every
    such window. Those that are rarest in the benchmark are taken.
    """

    BITS = 20

    def __init__(self, items: list[tuple[int, tuple[np.ndarray, np.ndarray]]], least: float):
        values, held = np.unique(np.concatenate([v for _, (v, _) in items]), return_counts=True)
        hashes, owners = [], []
        for i, (own, counts) in items:
            order = np.argsort(held[np.searchsorted(values, own)], kind="stable")
            m = int(counts.sum())
            spare = next(d for d in range(m + 1) if d == m or (m - d - 1) / m < least)  # shingles that a window may lack
            n = int(np.searchsorted(np.cumsum(counts[order]), spare, "right")) + 1
            hashes.append(own[order[:n]])
            owners.append(np.full(len(hashes[-1]), i))
        self.hashes, self.owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((self.owners, self.hashes))
        self.hashes, self.owners = self.hashes[order], self.owners[order]
        self.flag = np.zeros(1 << self.BITS, bool)
        self.flag[self.hashes & np.uint64((1 << self.BITS) - 1)] = True

    def spans(self, s: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """row, item, first and last place in the row: where a row holds probes of an item."""
        at = np.flatnonzero(self.flag[s & np.uint64((1 << self.BITS) - 1)])
        lo, hi = (np.searchsorted(self.hashes, s[at], side) for side in ("left", "right"))
        n = hi - lo
        row = np.repeat(np.searchsorted(rows, at, "right") - 1, n)
        item = self.owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        place = np.repeat(at, n) - rows[row]
        order = np.lexsort((place, item, row))
        row, item, place = row[order], item[order], place[order]
        first = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(item, prepend=-1).astype(bool))
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        return np.stack([row[first], item[first], place[first], place[last]], 1)


class Items:
    """The benchmark: each item's shingles, its class of window sizes, and the probes of the exact route."""

    def __init__(self, rows: list[tuple], radius: int, spread: int, least: float):
        self.ids = [i for i, _ in rows]
        self.words = []
        for _, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            self.words.append(word_hashes(raw, np.array([0, len(raw)]))[0])
        self.k = [min(N, len(w)) for w in self.words]
        self.shingles = [shingles(w, np.array([0, len(w)]), max(1, k))[0] for w, k in zip(self.words, self.k)]
        self.weights = [np.unique(s, return_counts=True) for s in self.shingles]
        # sizes are taken together with those a little larger: the window has the least of them, so every text that can hold the item has one
        sizes: dict[int, dict[int, list]] = {}
        for k in sorted(set(self.k) - {0}):
            own = sorted((i for i in range(len(rows)) if self.k[i] == k), key=lambda i: len(self.shingles[i]))
            smallest = 0
            for i in own:
                n = len(self.shingles[i])
                if not smallest or n > smallest + max(spread, smallest // 16):
                    smallest = n
                sizes.setdefault(k, {}).setdefault(smallest, []).append((i, self.shingles[i]))
        self.sizes = {k: [Size(items, length, radius) for length, items in by.items()] for k, by in sizes.items()}
        self.probes = {k: Probes([(i, self.weights[i]) for i in range(len(rows)) if self.k[i] == k], least) for k in sizes}


_known: dict = {}


def _items(block, radius: int, spread: int, least: float) -> Items:
    """Built once in each worker, from a broadcast block of the benchmark."""
    name, rows = block.value
    key = name, radius, spread, least
    if key not in _known:
        _known.clear()
        _known[key] = Items(rows, radius, spread, least)
    return _known[key]


def similarity(a: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> float:
    """Weighted Jaccard similarity of an item's shingles and a window's, each shingle weighing as often as it occurs."""
    values, counts = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(a[0], values), len(a[0]) - 1)
    low = np.minimum(a[1][at], counts)[a[0][at] == values].sum()
    return float(low / (a[1].sum() + counts.sum() - low))


def overlaps(a: tuple[np.ndarray, np.ndarray], s: np.ndarray, m: int) -> np.ndarray:
    """For every window of m shingles in s, or what is left of s from its start, how many it shares with the item, each as often as both have it.

    The w + 1st last occurrence of a shingle that the item has w times is beyond what counts, so an occurrence counts in the windows
    that hold it and not the one w occurrences earlier: a run of starts, and the sum of all runs gives all windows at once.
    """
    place = np.minimum(np.searchsorted(a[0], s), len(a[0]) - 1)
    hit = np.flatnonzero(a[0][place] == s)
    kind = place[hit]
    order = np.argsort(kind, kind="stable")
    hit, kind = hit[order], kind[order]
    rank = np.arange(len(hit)) - np.searchsorted(kind, kind, "left")
    many = a[1][kind]
    earlier = np.where(rank >= many, hit[np.maximum(np.arange(len(hit)) - many, 0)], -1)
    lo, hi = np.maximum(np.maximum(hit - m, earlier) + 1, 0), hit + 1
    ok = lo < hi
    step = np.zeros(len(s) + 1, np.int64)
    np.add.at(step, lo[ok], 1)
    np.add.at(step, hi[ok], -1)
    return np.cumsum(step)[:-1]


def _exact(s: np.ndarray, rows: np.ndarray, probes: Probes, items: Items, least: float):
    """row, item, similarity, first word: the best window of each item in each row that holds one of its probes."""
    for row, item, first, last in probes.spans(s, rows).tolist():
        m = len(items.shingles[item])
        lo, hi = max(rows[row] + first - m + 1, rows[row]), min(rows[row] + last + m, rows[row + 1])
        shared = overlaps(items.weights[item], s[lo:hi], m)[: rows[row] + last + 1 - lo]  # later starts hold no probe
        size = np.minimum(m, rows[row + 1] - lo - np.arange(len(shared)))  # m, or what is left of the document
        alike = shared / (m + size - shared)
        at = int(np.argmax(alike))
        x = float(alike[at])
        if x >= least:
            yield row, item, x, int(lo - rows[row] + at)


def _found(data: np.ndarray, at: np.ndarray, items: Items, least: float) -> list[tuple[int, int, float, int]]:
    """row, item, similarity, first word: each row's best window for each item that reaches the threshold."""
    h, _, _, word_rows = word_hashes(data, at)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for k, sizes in items.sizes.items():
        counts = np.diff(word_rows)
        s, rows = shingles(h, word_rows, k)
        if k > 1:  # rows with fewer than k words have no window of k
            long = counts >= k
            s, rows = s[np.repeat(long, np.diff(rows))], np.concatenate([[0], np.cumsum(np.where(long, np.diff(rows), 0))])
        room = np.repeat(rows[1:], np.diff(rows)) - np.arange(len(s))
        longest = max(x.length for x in sizes)
        kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
        step = 65536
        for lo in range(0, len(s), step):
            hi = min(lo + step + longest, len(s))
            total = _running(s[lo:hi], kind)
            for size in sizes:
                n = min(step, hi - lo - size.length + 1)
                if n <= 0:
                    continue
                ones = (total[size.length : size.length + n] - total[:n]).view(kind)
                prints = np.packbits(ones.ravel() > size.length // 2, bitorder="little").view(np.uint64)
                for window, item in zip(*size.near(prints, room[lo : lo + n] >= size.length)):
                    row = int(np.searchsorted(rows, lo + window, "right")) - 1
                    known, place = best.get((row, item), (0.0, -1))
                    if known >= 1 and abs(place - (lo + window - rows[row])) < size.length:
                        continue
                    m = len(items.shingles[item])
                    for start in range(max(lo + window - (m - size.length) - 1, rows[row]), min(lo + window + 1, rows[row + 1] - m) + 1):
                        x = similarity(items.weights[item], s[start : start + m])
                        if x >= least and x > known:
                            known, place = x, int(start - rows[row])
                            best[row, item] = known, place
        best.update(((row, item), (x, place)) for row, item, x, place in _exact(s, rows, items.probes[k], items, least))
    return sorted((r, i, x, p) for (r, i), (x, p) in best.items())


def _report(batches, block, radius: int, spread: int, least: float):
    items = _items(block, radius, spread, least)
    for batch in batches:
        for first, data, at in pieces(batch.column("text")):
            found = _found(data, at, items, least)
            doc = batch.column("doc_id").take(pa.array([first + r for r, *_ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array([items.ids[i] for _, i, _, _ in found], pa.int64()), pa.array([x for _, _, x, _ in found], pa.float64()), pa.array([p for *_, p in found], pa.int64())], ["doc_id", "item_id", "similarity", "first_word"])


def _clean(batches, block, radius: int, spread: int, least: float):
    items = _items(block, radius, spread, least)
    for batch in batches:
        bad = [first + r for first, data, at in pieces(batch.column("text")) for r, *_ in _found(data, at, items, least)]
        keep = np.ones(len(batch), bool)
        keep[bad] = False
        yield batch.filter(pa.array(keep))


def _blocks(benchmark: DataFrame):
    """The items in the order of their ids, broadcast a bounded number and a bounded size at a time (an item above it stands alone)."""
    small_batches(benchmark.sparkSession)
    send = lambda rows: benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))
    block, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"] or "")
        if block and (len(block) >= BLOCK or size + n > BLOCK_BYTES):
            yield send(block)
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield send(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 11, spread: int = 0) -> DataFrame:
    """doc_id, item_id, similarity, first_word: for every row of docs (doc_id, text) the items of benchmark (item_id, text) it holds.

    An item is held if a window with as many words as it has, or with what is left of a text that ends before, is at least `least` similar: weighted Jaccard of 5-word shingles
    (all words of a shorter item; words: see WORDS, neither case nor punctuation counts), each weighing as often as it occurs. The best window is reported, the first on ties.
    Null or empty texts hold nothing and null or empty items aren't held; a very long text is looked through in whole, 65,536 words at
    a time; other columns are ignored; a repeated row is reported again, a repeated item too; an empty table on either side
    gives no rows. A benchmark of any size is taken in blocks (see BLOCK), one pass over the documents each.

    Windows of every item size (sizes that differ by at most a sixteenth, or `spread`, share the smallest) slide over all words; their
    64-bit SimHash meets the items' in the multi-index, which gives all within `radius` bits; these are verified exactly. Windows
    at the threshold are often beyond the radius, so an exact route follows: every window that can reach `least` holds one of a few
    of the item's shingles (see Probes), and each row with one of those has all its windows there compared. Together they miss none.
    """
    found = [docs.select("doc_id", "text").mapInArrow(lambda it, block=block: tidy(_report(it, block, radius, spread, least)), "doc_id long, item_id long, similarity double, first_word long") for block in _blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, first_word long")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 11, spread: int = 0) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of benchmark; see find_leaks.

    Rows with a null or empty text stay, repeated rows stay or go alike, and an empty benchmark leaves docs as they are.
    """
    schema = docs.schema
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(lambda it, block=block: tidy(_clean(it, block, radius, spread, least)), schema)
    return docs
