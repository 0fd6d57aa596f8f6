"""The edits of record files as DataFrame expressions over (record_index, record): what the byte-level edits must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recframe.errors import Refused


def truncate(df: DataFrame, records: int) -> DataFrame:
    return df.where(F.col("record_index") < records)


def copy_range(df: DataFrame, start: int, count: int | None = None) -> DataFrame:
    kept = df.where(F.col("record_index") >= start)
    kept = kept if count is None else kept.where(F.col("record_index") < start + count)
    return kept.withColumn("record_index", F.col("record_index") - start)


def concat(first: DataFrame, total: int, second: DataFrame) -> DataFrame:
    """second after the `total` records of first: no shuffle."""
    return first.select("record_index", "record").unionAll(second.select((F.col("record_index") + total).alias("record_index"), "record"))


def rewritten_frames(total: int, more: int, per_frame: int) -> range:
    """The frames that an append of `more` records to `total` encodes."""
    if per_frame <= 0:
        raise Refused("a frame holds at least one record")
    return range(total // per_frame, -(-(total + more) // per_frame)) if more else range(0)


def uniformity(df: DataFrame, per_frame: int) -> DataFrame:
    """Frames, by a frame column, that don't hold per_frame records, but for a last one with fewer."""
    counts = df.groupBy("frame").agg(F.count("*").alias("cnt"))
    last = df.agg(F.max("frame").alias("last")).scalar()
    return counts.where(F.when(F.col("frame") < last, F.col("cnt") != per_frame).otherwise(F.col("cnt") > per_frame))
