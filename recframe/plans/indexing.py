"""Dense record indices and frame numbers as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recframe.errors import SpecError
from recframe.session import written


def with_record_index(df: DataFrame, *order_by: str | Column, name: str = "record_index") -> DataFrame:
    """df with a dense index from 0 in the given order, without a window over all rows.

    Rows are dealt by ranges and sorted within them; what is counted on the driver is one number a partition.
    """
    if not order_by:
        raise SpecError("rows have no order of their own: say what to order by")
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    fixed = written(dealt.withColumns({"_part": F.shiftright(at, 33).cast("int"), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted((r["_part"], r["count"]) for r in fixed.groupBy("_part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part] = total
        total += n
    if not before:
        return fixed.drop("_part", "_at").withColumn(name, F.lit(None).cast("long"))
    offsets = df.sparkSession.createDataFrame(list(before.items()), "_part int, _before long")
    # one row a partition, which Catalyst can't know: without the hint it would collect small tables of rows instead
    return fixed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def with_frames(df: DataFrame, per_frame: int, index: str = "record_index") -> DataFrame:
    """df with the frame and the place in it that a record index has."""
    if per_frame <= 0:
        raise SpecError("a frame holds at least one record")
    return df.withColumns({"frame": F.floor(F.col(index) / per_frame).cast("int"), "frame_at": F.pmod(F.col(index), F.lit(per_frame)).cast("int")})


def derive_per_frame(df: DataFrame, frame_size: int, record: str = "record", index: str = "record_index") -> int:
    """Records of frame 0: up to the first whose end reaches frame_size, it included; all if none does.

    Only the head is read, in slices that double until one is long enough.
    """
    head = 1024
    while True:
        first = df.where(F.col(index) < head).select(index, F.octet_length(record).alias("size"))
        run = first.withColumn("end", F.sum("size").over(Window.orderBy(index)))
        x = run.agg(F.min(F.when(F.col("end") >= frame_size, F.col(index))).alias("at"), F.count("*").alias("n")).first()
        if x["at"] is not None:
            return x["at"] + 1
        if x["n"] < head:
            return max(1, x["n"])
        head *= 4


def _size_blocks(batches, frame_size: int, block: int) -> Iterator[pa.RecordBatch]:
    """Runs of up to `block` records in order: their indices and ends, and for every record that can be the first cut, as the open frame
    holds 0 to frame_size - 1 bytes by then, its end and what is left after the last cut that follows from it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def done(index: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        lo, hi = np.searchsorted(ends, (1, frame_size))
        cuts = np.arange(lo, min(hi + 1, len(ends)))
        at = ends[cuts]
        while len(cuts) and (more := (after := np.searchsorted(ends, ends[cuts] + frame_size)) < len(ends)).any():
            cuts = np.where(more, after, cuts)
        packed = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (at, ends[-1] - ends[cuts], index, ends)]
        return pa.RecordBatch.from_arrays([pa.array([index[0]], pa.int64()), pa.array([ends[-1]], pa.int64()), *packed], ["first", "total", "at", "left", "indices", "ends"])

    for batch in batches:
        index, sizes = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        while len(index):
            n = min(block - count, len(index))
            held.append((index[:n], sizes[:n]))
            count, index, sizes = count + n, index[n:], sizes[n:]
            if count == block:
                yield done(*(np.concatenate(x) for x in zip(*held)))
                held, count = [], 0
    if held:
        yield done(*(np.concatenate(x) for x in zip(*held)))


def _link(blocks: list, frame_size: int) -> dict[int, int]:
    """By the blocks' first indices: the bytes that the open frame holds when a block begins."""
    before, open_ = {}, 0
    for first, total, at, left in blocks:
        before[first] = open_
        i = int(np.searchsorted(at, frame_size - open_))
        open_ = int(left[i]) if i < len(at) else open_ + total
    return before


def _last_indices(batches, before: dict[int, int], frame_size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, indices, ends in zip(*(c.to_pylist() for c in batch.columns)):
            indices, ends, cuts = np.frombuffer(indices, "<i8"), np.frombuffer(ends, "<i8"), []
            at = int(np.searchsorted(ends, frame_size - before[first]))
            while at < len(ends):
                cuts.append(at)
                at = int(np.searchsorted(ends, ends[at] + frame_size))
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([indices[cuts].tobytes()], pa.binary())], ["first", "lasts"])


def size_cuts(df: DataFrame, frame_size: int, record: str = "record", index: str = "record_index", block: int = 1 << 20) -> np.ndarray:
    """The index of the last record of every frame that is full, where a frame ends with the record whose end reaches frame_size.

    Each cut depends on the one before. So tasks walk a block of records for every place that its first cut can have, all of them
    records of its first frame_size bytes; the driver links the blocks by two numbers a place, and gets eight bytes a frame.
    """
    sizes = df.select(F.col(index).cast("long"), F.coalesce(F.octet_length(record), F.lit(0)).alias("size")).repartitionByRange(index).sortWithinPartitions(index)
    blocks = written(sizes.mapInArrow(lambda it: _size_blocks(it, frame_size, block), "first long, total long, at binary, left binary, indices binary, ends binary"))
    numbers = lambda x: np.frombuffer(x, "<i8")
    ends = sorted(blocks.select("first", "total", "at", "left").collect(), key=lambda r: r["first"])
    before = _link([(r["first"], r["total"], numbers(r["at"]), numbers(r["left"])) for r in ends], frame_size)
    found = blocks.select("first", "indices", "ends").mapInArrow(lambda it: _last_indices(it, before, frame_size), "first long, lasts binary").collect()
    return np.concatenate([np.zeros(0, np.int64), *(numbers(r["lasts"]) for r in sorted(found, key=lambda r: r["first"]))])


def with_sized_frames(df: DataFrame, frame_size: int) -> DataFrame:
    """record_index, record, frame: frames cut by size alone."""
    lasts = size_cuts(df, frame_size)

    def framed(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = np.searchsorted(lasts, b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(frame.astype(np.int32))], ["record_index", "record", "frame"])

    return df.select(F.col("record_index").cast("long"), F.col("record").cast("binary")).mapInArrow(framed, "record_index long, record binary, frame int")


def frame_table(df: DataFrame, record: str = "record") -> DataFrame:
    """frame, cnt, decomp_size, decomp_start, decomp_end of records with a frame: a few numbers a frame, then a running sum over frames."""
    sizes = df.groupBy("frame").agg(F.count("*").alias("cnt"), F.sum(F.octet_length(record)).cast("long").alias("decomp_size"))
    end = F.sum("decomp_size").over(Window.orderBy("frame"))
    return sizes.withColumns({"decomp_end": end}).withColumn("decomp_start", F.col("decomp_end") - F.col("decomp_size")).select("frame", "cnt", "decomp_start", "decomp_end", "decomp_size")
