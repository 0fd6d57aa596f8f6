"""Reads: ranges, points, ends, folds, metadata. Ranges reach the source as options, so frames are pruned whatever the session allows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import astuple
from functools import reduce
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recframe.errors import PastEnd, SpecError
from recframe.functions.boundary import Boundary, Custom, Separated
from recframe.functions.codec import decode
from recframe.session import register
from recframe.sources.container import decode_frame, has_checksum, read_bytes
from recframe.sources.layout import Facts, RecordFile, RecordFiles, expand, inner_format
from recframe.sources.records import count_frame, pack_counts, plan, read_frames, run_of

#: More files than these are opened by tasks, and only a few numbers a file come to the driver.
OPENED_BY_DRIVER = 256
FRAME_COLUMNS = "path string, frame int, comp_start long, comp_end long, comp_size long, decomp_start long, decomp_end long, decomp_size long"


class Handle:
    """One or more record files as one run of indices. Opening reads seek tables and first frames (of many files: by tasks); reads are lazy DataFrames."""

    def __init__(self, spark: SparkSession, path: str | list[str], boundary: Boundary | None = None, format: str | None = None, verify: bool = False, index_mode: str = "divide", partition_bytes: int | None = None):
        self.spark = register(spark)
        self.paths = expand(path)
        self.boundary = boundary or Separated(b"\n")
        self.format = format or inner_format(self.paths[0])
        many = len(self.paths) > OPENED_BY_DRIVER
        self.layout = RecordFiles(self.paths, self.boundary, self._opened_by_the_cluster() if many else None)
        self._options = {"verify": str(verify).lower(), "index_mode": index_mode}
        if partition_bytes:
            self._options["partition_bytes"] = str(partition_bytes)
        self._counted: np.ndarray | None = None

    def _listed(self, paths: list[str] | None = None) -> DataFrame:
        """number, path of the files, dealt to tasks."""
        paths = self.paths if paths is None else paths
        rows = self.spark.createDataFrame(list(enumerate(paths)), "number int, path string")
        return rows.repartition(min(len(paths), 4 * self.spark.sparkContext.defaultParallelism), "number") if len(paths) > 1 else rows.coalesce(1)

    def _opened_by_the_cluster(self) -> list[Facts]:
        """Every file opened by a task, its last frame counted too; a few numbers a file come back."""
        boundary = self.boundary
        found = self._listed().mapInArrow(lambda it: _open_files(it, boundary), "number int, size long, frames long, per_frame long, decompressed long, last_whole long, fragment boolean").collect()
        return [Facts(r["size"], r["frames"], r["per_frame"], r["decompressed"], r["last_whole"], r["fragment"]) for r in sorted(found)]

    def __eq__(self, other: object) -> bool:
        """The same files in the same order under the same boundary; the format doesn't matter."""
        return isinstance(other, Handle) and (self.paths, self.boundary.options()) == (other.paths, other.boundary.options())

    def __hash__(self) -> int:
        return hash((tuple(self.paths), tuple(self.boundary.options().items())))

    # ------------------------------------------------------------- scans

    def _load(self, **options: str) -> DataFrame:
        boundary = {"boundary_pickle": cloudpickle.dumps(self.boundary).hex()} if isinstance(self.boundary, Custom) else self.boundary.options()
        known = {"facts": json.dumps([astuple(f) for f in self.layout.facts])}
        if self.exact:
            known["counts"] = pack_counts(self._counts())
        return self.spark.read.format("recframe").options(paths=json.dumps(self.paths), **boundary, **known, **self._options, **options).load()

    @property
    def exact(self) -> bool:
        return self._options["index_mode"] == "exact"

    def _counts(self) -> np.ndarray:
        """The records of every frame of all files, counted by the cluster once for this handle; a number a frame comes back, as in a seek table."""
        if self._counted is None:
            number = {p: i for i, p in enumerate(self.paths)}
            rows = self._frames(False, whole=False).select("path", "frame", "cnt_of_sep").toArrow()
            order = np.lexsort((rows.column("frame").to_numpy(), [number[p] for p in rows.column("path").to_pylist()]))
            self._counted = rows.column("cnt_of_sep").to_numpy()[order]
        return self._counted

    def scan(self) -> DataFrame:
        """Every record; filters on record_index prune frames."""
        return self._load(pushdown="true")

    def records(self, start: int = 0, count: int | None = None) -> DataFrame:
        """count records from start (None: to the end). What can't be placed is refused here, not when the rows are read, even for a count of 0."""
        if self.exact:
            plan(self.layout, start, count, self._options, counts=self._counts())
        else:
            self.layout.spans(start, count)
        return self._load(**{"from": str(start)} | ({} if count is None else {"cnt": str(count)}))

    def values(self, start: int = 0, count: int | None = None, schema: str | None = None, **more: Any) -> DataFrame:
        """records, decoded by the handle's format."""
        return decode(self.records(start, count), self.format, self.boundary.separator, schema, **more)

    def slice(self, start: int, stop: int) -> DataFrame:
        """Records [start, stop), clipped to those there are."""
        total = self.total()
        start, stop = min(max(start, 0), total), min(stop, total)
        return self._load(**{"from": str(start), "cnt": str(max(0, stop - start))}) if start < stop else self._load(**{"from": "0", "cnt": "0"})

    def head(self, n: int) -> DataFrame:
        return self.records(0, n)

    def tail(self, n: int) -> DataFrame:
        """The last n records, in order."""
        return self.slice(self.total() - n, self.total())

    def skip(self, n: int) -> DataFrame:
        return self.slice(n, self.total())

    def reverse(self, n: int | None = None) -> DataFrame:
        """The last n records (None: all), last first, with rev from 0; the source reads backwards, so nothing is sorted."""
        total = self.total()
        n = total if n is None else min(n, total)
        return self._load(**{"from": str(total - n if n else 0), "cnt": str(n), "reverse": "true"}).withColumn("rev", F.lit(total - 1) - F.col("record_index"))

    def shard(self, i: int, of: int) -> DataFrame:
        """Worker i's share of the frames of all files: contiguous, without coordination between workers."""
        if not 0 <= i < of:
            raise SpecError(f"there is no shard {i} of {of}")
        frames = self.layout.frames
        return self.slice(*(self.layout.frame_start(frames * k // of) for k in (i, i + 1)))

    def from_frame(self, frame: int) -> DataFrame:
        """A worker's view from a frame on (counted through all files), with indices from 0 again."""
        if not 0 <= frame < self.layout.frames:
            raise SpecError(f"there is no frame {frame}: the files have {self.layout.frames}")
        start = self.layout.frame_start(frame)
        return self.records(start).withColumn("record_index", F.col("record_index") - start)

    # ------------------------------------------------------------- points and folds

    def _batches(self, start: int, count: int | None, lookup: bool = False) -> Iterator[pa.RecordBatch]:
        """The range's frames, read by this process one after the other."""
        for part in plan(self.layout, start, count, self._options | {"partition_bytes": str(1 << 20), "lookup": str(lookup)}, counts=self._counts() if self.exact else None):
            yield from read_frames(part)

    def record(self, i: int) -> bytes | None:
        """One record, None past the end: one frame is read, by the driver, without a job."""
        try:
            return next((b.column("record")[0].as_py() for b in self._batches(i, 1, lookup=True)), None)
        except ValueError as e:
            from recframe.errors import NoSeparator

            if isinstance(e, (PastEnd, NoSeparator)):
                return None
            raise

    def get(self, i: int, optional: bool = False) -> Any:
        """One value over all files, decoded by the format; past the end it's refused, or None where optional."""
        raw = self.record(i)
        if raw is None:
            if optional:
                return None
            raise PastEnd(f"there is no record {i}: the last is {self.total() - 1}")
        raw = raw.removesuffix(self.boundary.separator) if self.boundary.separator else raw
        if self.format == "json":
            return json.loads(raw)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw

    def chunks(self, start: int = 0, count: int | None = None) -> Iterator[memoryview]:
        """The bytes of a range, a frame at a time: no more than a few frames are held, whatever the range."""
        if not self.exact:
            self.layout.spans(start, count)
        for batch in self._batches(start, count):
            yield run_of(batch.column("record"))[0]

    def write_to(self, out: BinaryIO, start: int = 0, count: int | None = None) -> int:
        """Write the bytes of a range to a file or another writer, in bounded memory; gives how many they are."""
        size = 0
        for chunk in self.chunks(start, count):
            out.write(chunk)
            size += len(chunk)
        return size

    def cat(self, start: int = 0, count: int | None = 1) -> bytes:
        """The bytes of a range, joined."""
        return b"".join(self.chunks(start, count))

    def fold(self, step: Callable[[Any, bytes], Any], first: Any, start: int = 0, count: int | None = None) -> Any:
        """An ordered left fold, by the driver and a partition at a time; what commutes is better an aggregate of records().

        The source's partitions follow each other in the order of the indices, so nothing is sorted.
        """
        rows = self.records(start, count).select("record").toLocalIterator(prefetchPartitions=True)
        return reduce(lambda a, r: step(a, bytes(r["record"])), rows, first)

    # ------------------------------------------------------------- metadata

    def total(self) -> int:
        """Records: by division, for which the last frame of each file is decoded, or as counted."""
        return int(self._counts().sum()) if self.exact else self.layout.total

    def _frame_rows(self, fast: bool | None, frames: tuple[int, int] | None = None) -> DataFrame:
        """A row a frame, without counts that aren't known yet: from the tables of this handle, or of many files by tasks, where the driver lists files alone."""
        if len(self.paths) > OPENED_BY_DRIVER:
            boundary = self.boundary
            rows = self._listed().mapInArrow(lambda it: _tables(it, boundary, fast, frames), f"{FRAME_COLUMNS}, last boolean, known long")
            return rows if fast is None else rows.repartition("path", F.floor(F.col("frame") / 64))
        held = [b for f in self.layout.files for b in _rows_of(f, fast, frames)]
        return self.spark.createDataFrame(pa.Table.from_batches(held)) if held else self.spark.createDataFrame([], f"{FRAME_COLUMNS}, last boolean, known long")

    def _frames(self, fast: bool, frames: tuple[int, int] | None = None, whole: bool = True) -> DataFrame:
        """path, frame, sizes and counts; frames are counted by tasks."""
        boundary = self.boundary
        return self._frame_rows(fast, frames).mapInArrow(lambda it: _count_frames(it, boundary, whole), f"{FRAME_COLUMNS}, cnt_of_sep long")

    def inspect(self, fast: bool = True) -> DataFrame:
        """path, frame, comp_start, comp_end, comp_size, decomp_start, decomp_end, decomp_size, sep, cnt_of_sep: one row a frame.

        fast counts the first and the last two frames of a file and takes the rest as full; else every frame is counted.
        """
        rows = self._frames(fast)
        return rows.withColumn("sep", F.lit(self.boundary.separator)).select(*rows.columns[:-1], "sep", "cnt_of_sep")

    def frame_rows(self, fast: bool = True) -> DataFrame:
        """index, comp_start, comp_end, comp_size, decomp_start, decomp_end, decomp_size, records: the same as a listing shows it."""
        return self._frames(fast).select(F.col("frame").alias("index"), "comp_start", "comp_end", "comp_size", "decomp_start", "decomp_end", "decomp_size", F.col("cnt_of_sep").alias("records"))

    def count_frames(self, start: int, end: int) -> DataFrame:
        """path, frame, cnt_of_sep: whole records of the frames [start, end) of each file, counted by the cluster."""
        if not 0 <= start <= end:
            raise SpecError(f"frames {start} to {end} make no range")
        return self._frames(False, (start, end)).select("path", "frame", "cnt_of_sep")

    def verify(self) -> DataFrame:
        """The frames that break the layout: not as many records as frame 0, or, for a last one, more. None for a whole file."""
        rows = self.inspect(fast=False)
        full = self.spark.createDataFrame([(f.path, f.per_frame, f.frames - 1) for f in self.layout.files], "path string, records_per_frame long, last int")
        return rows.join(full, "path").where(F.when(F.col("frame") < F.col("last"), F.col("cnt_of_sep") != F.col("records_per_frame")).otherwise(F.col("cnt_of_sep") > F.col("records_per_frame"))).drop("records_per_frame", "last")

    def checksums(self) -> DataFrame:
        """path, frame, checksum: whether each frame carries a checksum of its content."""
        return self._frame_rows(None).mapInArrow(_checksums, "path string, frame int, checksum boolean")

    def summary(self) -> DataFrame:
        """path, finder, finder_arg, format, frames, records_per_frame, records: one row a file, never data."""
        rows = [(f.path, self.boundary.name, self.boundary.argument, self.format, f.frames, f.per_frame, f.total) for f in self.layout.files]
        return self.spark.createDataFrame(rows, "path string, finder string, finder_arg string, format string, frames long, records_per_frame long, records long")

    def field(self, name: str, optional: bool = False) -> Any:
        """One field of the summary, whatever its case: a scalar for one file, else a list; records are counted only if asked for."""
        found = {
            "path": lambda f: f.path,
            "finder": lambda f: self.boundary.name,
            "finder_arg": lambda f: self.boundary.argument,
            "format": lambda f: self.format,
            "frames": lambda f: f.frames,
            "records_per_frame": lambda f: f.per_frame,
            "records": lambda f: f.total,
        }.get(name.lower())
        if found is None:
            if optional:
                return None
            raise SpecError(f"a handle has no field {name!r}")
        values = [found(f) for f in self.layout.files]
        return values[0] if len(values) == 1 else values


def _open_files(batches, boundary: Boundary):
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            file = RecordFile(path, boundary)
            file.last_whole  # decodes the last frame, so that facts hold it
            rows.append(astuple(file.facts))
        yield pa.RecordBatch.from_arrays([batch.column("number"), *(pa.array(x) for x in zip(*rows))], ["number", "size", "frames", "per_frame", "decompressed", "last_whole", "fragment"])


def _rows_of(file: RecordFile, fast: bool | None, frames: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """A file's frames [a, b) (None: all), with what is known of their counts: fast takes inner ones as full; None asks for no count."""
    c, d = file.table.starts(file.table.compressed), file.table.starts(file.table.decompressed)
    first, end = (0, file.frames) if frames is None else (min(x, file.frames) for x in frames)
    for lo in range(first, end, 65536):
        at = np.arange(lo, min(lo + 65536, end))
        inner = (at > 0) & (at < file.frames - 2) if fast else np.full(len(at), fast is None)
        sizes = [pa.array(x) for x in (c[at], c[at + 1], c[at + 1] - c[at], d[at], d[at + 1], d[at + 1] - d[at])]
        yield pa.RecordBatch.from_arrays([pa.array([file.path] * len(at)), pa.array(at.astype(np.int32)), *sizes, pa.array(at == file.frames - 1), pa.array(np.full(len(at), file.per_frame), mask=~inner)], [*(x.split()[0] for x in FRAME_COLUMNS.split(", ")), "last", "known"])


def _tables(batches, boundary: Boundary, fast: bool | None, frames: tuple[int, int] | None):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            yield from _rows_of(RecordFile(path, boundary), fast, frames)


def _count_frames(batches, boundary: Boundary, whole: bool):
    """whole: a fragment that is the file's final record doesn't count."""
    for batch in batches:
        counts = batch.column("known").to_pylist()
        for i, r in enumerate(batch.to_pylist()):
            if counts[i] is None:
                data = decode_frame(read_bytes(r["path"], r["comp_start"], r["comp_size"]), r["decomp_size"])
                counts[i] = count_frame(boundary, data, r["last"] and not whole)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(counts, pa.int64())], [*batch.schema.names[:-2], "cnt_of_sep"])


def _checksums(batches):
    for batch in batches:
        found = [has_checksum(p, at) for p, at in zip(batch.column("path").to_pylist(), batch.column("comp_start").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("frame"), pa.array(found, pa.bool_())], ["path", "frame", "checksum"])


def open_records(spark: SparkSession, path: str | list[str], boundary: Boundary | None = None, **options: Any) -> Handle:
    """Open one or more record files, a folder or a pattern."""
    return Handle(spark, path, boundary, **options)
