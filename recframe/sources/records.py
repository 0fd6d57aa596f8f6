"""The `recframe` data source: record files as rows of path, file_index, frame, record_index, record.

Options: path (a file, folder or pattern) or paths (a JSON list); the boundary (separator, separator_hex, finder,
finder_arg); from and cnt (a range of record indices); verify; index_mode (divide or exact); partition_bytes; pushdown;
reverse (last record first). A handle adds facts (what its opening found, so that nothing is opened again) and counts (for exact).
"""

from __future__ import annotations

import base64
import json
import os
import pickle
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from recframe.errors import IncompleteFrame, PastEnd, RecordError, SpecError, Uneven
from recframe.functions.boundary import Boundary, from_options
from recframe.plans.framing import FrameCutter, Framing
from recframe.sources.container import FrameTable, decode_frame, encode_frame, filesystem, read_bytes, read_seek_table, seek_table
from recframe.sources.layout import SUFFIX, Facts, RecordFile, RecordFiles, expand

SCHEMA = "path string, file_index int, frame int, record_index long, record binary"
#: Decompressed bytes that one task reads.
PARTITION_BYTES = 64 << 20


@dataclass
class FrameRange(InputPartition):
    """Consecutive frames of one file. Where the planner had the seek table, their sizes come along and a task reads nothing else of the file."""

    path: str
    file_index: int
    first: int  # frame
    end: int
    index: int  # of the first record of the first frame
    low: int
    high: int  # indices wanted
    per_frame: int
    last: bool  # whether the file's last frame is among them
    verify: int  # 0: nothing is judged; 1: frames whose end the request reaches; 2: those it goes beyond, as a lookup that found nothing
    boundary: bytes
    start: int = -1  # byte; -1: the table is still to be read
    compressed: np.ndarray | None = None
    decompressed: np.ndarray | None = None

    def sized(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Where the frames start in the file, and their sizes."""
        if self.compressed is not None:
            return self.start, self.compressed, self.decompressed
        table = read_seek_table(self.path)
        if len(table) < self.end:
            raise RecordError(f"{self.path} has changed since it was opened: it has {len(table)} frames rather than {self.end} or more")
        return int(table.compressed[: self.first].astype(np.int64).sum()), table.compressed[self.first : self.end], table.decompressed[self.first : self.end]


def _boundary(options: dict[str, str]) -> Boundary:
    if custom := options.get("boundary_pickle"):
        return pickle.loads(bytes.fromhex(custom))
    return from_options(options)


def _true(value: str | None) -> bool:
    return str(value).lower() in ("true", "1", "yes")


def _judge(part: FrameRange, boundary: Boundary, i: int, ends: np.ndarray, size: int, past: int) -> None:
    """Refuse a frame that breaks the layout. past: how many records the request wants beyond the frame's whole ones.

    Only what the request walks is judged: under `verify` a frame whose end it reaches (past is 0 or more; above 0 for a lookup),
    otherwise one whose fragment stands in its way (past above 0).
    """
    final = part.last and i == part.end - part.first - 1
    named = f"frame {part.first + i} of {part.path}"
    judged = part.verify and past >= part.verify - 1
    if judged and (len(ends) > part.per_frame if final else len(ends) != part.per_frame):
        raise Uneven(f"{named} holds {len(ends)} records rather than {part.per_frame}: another writer or boundary made this file")
    if not final and (int(ends[-1]) if len(ends) else 0) != size:
        if judged:
            raise Uneven(f"{named} holds bytes after its last record: another writer or boundary made this file")
        if past > 0:
            raise IncompleteFrame(f"a record goes on past the end of {named}, which isn't the last")


#: Compressed bytes that a task reads at once.
READ_BYTES = 16 << 20


def _raw_frames(part: FrameRange, backwards: bool = False) -> Iterator[tuple[bytes, int]]:
    """The frames as they are, with their decompressed sizes, first or last frame first: a file is read some megabytes at a time."""
    at, compressed, decompressed = part.sized()
    ends = np.cumsum(compressed.astype(np.int64))
    reads, i = [], 0
    while i < len(ends):
        before = int(ends[i - 1]) if i else 0
        reads.append((i, max(i + 1, int(np.searchsorted(ends, before + READ_BYTES, "right"))), before))
        i = reads[-1][1]
    order = reversed if backwards else iter
    for i, j, before in order(reads):
        raw = read_bytes(part.path, at + before, int(ends[j - 1]) - before)
        for k in order(range(i, j)):
            lo = (int(ends[k - 1]) if k else 0) - before
            yield raw[lo : int(ends[k]) - before], int(decompressed[k])


def _record_ends(part: FrameRange, boundary: Boundary, i: int, data: bytes) -> tuple[np.ndarray, int]:
    """Where the records of frame i end, a fragment that is the file's final record too; and how many are whole."""
    ends = boundary.ends(data)
    whole = len(ends)
    if (int(ends[-1]) if whole else 0) < len(data) and boundary.fragment_is_record and part.last and i == part.end - part.first - 1:
        ends = np.append(ends, len(data))
    return ends, whole


def _rows(part: FrameRange, i: int, index: int, data: bytes, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The wanted records of frame i, whose first is `index`: slices of the frame's bytes, not copies."""
    lo, hi = max(part.low - index, 0), min(part.high - index, len(ends))
    if lo < hi:
        offsets = np.concatenate([[0], ends]).astype(np.int32)[lo : hi + 1]
        record = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.path] * (hi - lo), pa.string()), pa.array(np.full(hi - lo, part.file_index, np.int32)), pa.array(np.full(hi - lo, part.first + i, np.int32)), pa.array(np.arange(index + lo, index + hi)), record],
            ["path", "file_index", "frame", "record_index", "record"],
        )


def _judged_frames(part: FrameRange, boundary: Boundary) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Frame, index of its first record, content, record ends."""
    index = part.index
    for i, (raw, out) in enumerate(_raw_frames(part)):
        data = decode_frame(raw, out)
        ends, whole = _record_ends(part, boundary, i, data)
        _judge(part, boundary, i, ends[:whole], len(data), part.high - index - whole)
        yield i, index, data, ends
        index += len(ends)


def read_frames(part: FrameRange) -> Iterator[pa.RecordBatch]:
    """A batch for each frame."""
    for i, index, data, ends in _judged_frames(part, pickle.loads(part.boundary)):
        yield from _rows(part, i, index, data, ends)


def read_backwards(part: FrameRange) -> Iterator[pa.RecordBatch]:
    """The same rows, last first. A first pass judges the frames and notes where each begins, as only the counts of those before tell it;
    a second one decodes them again from the last on. So one frame and what is read at once are held, however many there are."""
    boundary: Boundary = pickle.loads(part.boundary)
    firsts = np.fromiter((index for _, index, _, _ in _judged_frames(part, boundary)), np.int64)
    for i, (raw, out) in zip(range(len(firsts) - 1, -1, -1), _raw_frames(part, backwards=True)):
        data = decode_frame(raw, out)
        for batch in _rows(part, i, int(firsts[i]), data, _record_ends(part, boundary, i, data)[0]):
            yield batch.take(pa.array(np.arange(len(batch) - 1, -1, -1)))


def _cuts(file: RecordFile, a: int, b: int, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of the frames [a, b) that hold about `limit` bytes: by their sizes where the table is here, else by the file's mean."""
    if file.table_is_here:
        ends = np.cumsum(file.table.decompressed[a:b].astype(np.int64))
        i = 0
        while i < b - a:
            j = max(i + 1, int(np.searchsorted(ends, (int(ends[i - 1]) if i else 0) + limit, "right")))
            yield a + i, a + j
            i = j
    else:
        step = max(1, limit * file.frames // max(1, file.facts.decompressed))
        yield from ((i, min(i + step, b)) for i in range(a, b, step))


def _range(file: RecordFile, number: int, a: int, b: int, index: int, low: int, high: int, verify: int, packed: bytes) -> FrameRange:
    part = FrameRange(file.path, number, a, b, index, low, high, file.per_frame, b == file.frames, verify, packed)
    if file.table_is_here:
        part.start = int(file.table.compressed[:a].astype(np.int64).sum())
        part.compressed, part.decompressed = file.table.compressed[a:b], file.table.decompressed[a:b]
    return part


def plan(files: RecordFiles, start: int, count: int | None, options: dict[str, str], clip: bool = False, counts: np.ndarray | None = None) -> list[FrameRange]:
    """Frame ranges of about partition_bytes for a range of indices. clip: a range past the end is empty, not refused.

    counts: the records of every frame of all files, for index_mode exact.
    """
    limit, verify = int(options.get("partition_bytes", PARTITION_BYTES)), _true(options.get("verify")) * (2 if _true(options.get("lookup")) else 1)
    packed, out = cloudpickle.dumps(files.boundary), []
    mode = options.get("index_mode", "divide")
    if mode not in ("divide", "exact"):
        raise SpecError(f"index_mode is divide or exact, not {mode!r}")
    if mode == "exact":
        return _plan_exact(files, start, count, limit, packed, clip, _count_here(files) if counts is None else counts)
    if clip:
        total = files.total
        start, count = min(start, total), None if count is None else max(0, min(count, total - start))
        if start >= total or count == 0:
            return []
    for number, before, span in files.spans(start, count):
        file = files.files[number]
        out += [_range(file, number, a, b, before + a * file.per_frame, before + span.low, before + span.high, verify, packed) for a, b in _cuts(file, span.first, span.end, limit)]
    return out


def count_frame(boundary: Boundary, data: bytes, final: bool) -> int:
    """Records of a frame, with the fragment that ends a file where that is one."""
    ends = boundary.ends(data)
    return len(ends) + (final and boundary.fragment_is_record and (int(ends[-1]) if len(ends) else 0) < len(data))


def _count_here(files: RecordFiles) -> np.ndarray:
    """The records of every frame, counted by threads of this process: for readers that no handle has counted for."""
    every = [(f, i) for f in files.files for i in range(f.frames)]
    with ThreadPoolExecutor() as pool:
        return np.fromiter(pool.map(lambda x: count_frame(files.boundary, x[0].frame_bytes(x[1]), x[1] == x[0].frames - 1), every), np.int64, len(every))


def _plan_exact(files: RecordFiles, start: int, count: int | None, limit: int, packed: bytes, clip: bool, counts: np.ndarray) -> list[FrameRange]:
    """Indices by position: every frame's records are counted first, so uneven files are numbered as they are read in full."""
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    total = int(ends[-1])
    if start < 0 or count is not None and count < 0:
        raise SpecError("a start and a count can't be negative")
    if start > total and not clip:
        raise PastEnd(f"there is no record {start}: {total} were counted")
    stop, out, frame = total if count is None else min(total, start + count), [], 0
    for number, file in enumerate(files.files):
        own = ends[frame : frame + file.frames + 1]
        frame += file.frames
        if start < stop:
            a, b = max(0, int(np.searchsorted(own, start, "right")) - 1), min(file.frames, int(np.searchsorted(own, stop, "left")))
            out += [_range(file, number, i, j, int(own[i]), start, stop, 0, packed) for i, j in _cuts(file, a, b, limit)]
    return out


def pack_counts(counts: np.ndarray) -> str:
    """Numbers as a reader option."""
    return base64.b64encode(zlib.compress(counts.astype("<i8").tobytes(), 1)).decode()


def _unpack_counts(text: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(base64.b64decode(text)), "<i8")


class RecordReader(DataSourceReader):
    """Plans frame ranges on the driver from the seek tables; tasks decode them."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.start, self.count = int(options.get("from", 0)), int(options["cnt"]) if options.get("cnt") not in (None, "") else None
        self.clip = False

    def _files(self) -> RecordFiles:
        named = json.loads(self.options["paths"]) if self.options.get("paths") else self.options.get("path")
        if not named:
            raise SpecError("a path is needed")
        if self.options.get("facts"):
            return RecordFiles(named, _boundary(self.options), [Facts(*x) for x in json.loads(self.options["facts"])])
        return RecordFiles(expand(named), _boundary(self.options))

    def partitions(self) -> list[FrameRange]:
        files = self._files()
        counts = _unpack_counts(self.options["counts"]) if self.options.get("counts") else None
        clip = self.clip and not (self.start == 0 and self.count is None)
        parts = plan(files, self.start, self.count, self.options, clip, counts)
        return parts[::-1] if _true(self.options.get("reverse")) and parts else parts or [FrameRange("", 0, 0, 0, 0, 0, 0, 0, False, 0, cloudpickle.dumps(files.boundary))]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        if partition.first < partition.end:
            yield from (read_backwards if _true(self.options.get("reverse")) else read_frames)(partition)


class PushedReader(RecordReader):
    """A reader that takes bounds on record_index from the query's filters and prunes frames by them."""

    def pushFilters(self, filters):
        low, high = self.start, None if self.count is None else self.start + self.count
        for f in filters:
            if getattr(f, "attribute", None) != ("record_index",):
                yield f
                continue
            least, most = None, None
            match f:
                case EqualTo(value=v):
                    least, most = v, v + 1
                case GreaterThan(value=v):
                    least = v + 1
                case GreaterThanOrEqual(value=v):
                    least = v
                case LessThan(value=v):
                    most = v
                case LessThanOrEqual(value=v):
                    most = v + 1
                case In(value=values):
                    known = [v for v in values if v is not None]
                    if known:
                        least, most = min(known), max(known) + 1
                    yield f  # only bounds are used
                case _:
                    yield f
                    continue
            low = low if least is None else max(low, least)
            high = high if most is None else most if high is None else min(high, most)
        self.start, self.count, self.clip = low, None if high is None else max(0, high - low), True


@dataclass
class Part(WriterCommitMessage):
    draft: str
    partition: int
    records: int


def run_of(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values of a string or binary column that aren't null, as one run of bytes and their ends, without a copy."""
    column = column.drop_null()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b"")[at[0] : at[-1]], at[1:] - at[0]


class RecordWriter(DataSourceArrowWriter):
    """Every task writes one whole record file under a draft name; commit names them in the order of the partitions."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.options, self.overwrite, self.path = options, overwrite, options["path"]
        names = schema.fieldNames()
        self.column = options.get("column") or next((c for c in ("record", "value") if c in names), None)
        if self.column not in names:
            raise SpecError("a record or value column is needed, or the option column")
        self.boundary = _boundary(options)
        self.framing = Framing.from_options(options)
        self.job = uuid4().hex
        self.extension = options.get("extension", "bin" if self.column == "record" else "txt")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = filesystem(self.path)
        store.create_dir(base, recursive=True)
        draft = f"{base}/_draft-{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}"
        cutter, sizes, records = FrameCutter(self.framing), [], 0
        with store.open_output_stream(draft, compression=None) as out:

            def put(frames) -> int:
                n = 0
                for data, count in frames:
                    raw = encode_frame(data, self.framing.level, self.framing.checksum)
                    out.write(raw)
                    sizes.append((len(raw), len(data)))
                    n += count
                return n

            for batch in batches:
                records += put(cutter.feed(*run_of(batch.column(batch.schema.get_field_index(self.column)))))
            records += put(cutter.finish())
            if sizes:
                out.write(seek_table(FrameTable(*(np.array(x, np.uint32) for x in zip(*sizes)))))
        if not sizes:
            store.delete_file(draft)
        return Part(draft if sizes else "", context.partitionId(), records)

    def commit(self, messages: list[Part | None]) -> None:
        store, base = filesystem(self.path)
        store.create_dir(base, recursive=True)
        old = [i.path for i in store.get_file_info(fs.FileSelector(base)) if i.is_file and i.base_name.startswith("part-")]
        first = 0 if self.overwrite else 1 + max((int(os.path.basename(p)[5:13]) for p in old), default=-1)
        parts = sorted((m for m in messages if m and m.draft), key=lambda m: m.partition)
        if self.overwrite:
            for p in old:
                store.delete_file(p)
        for i, m in enumerate(parts):
            store.move(m.draft, f"{base}/part-{first + i:08d}.{self.extension}{SUFFIX}")

    def abort(self, messages: list[Part | None]) -> None:
        store, base = filesystem(self.path)
        for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if i.base_name.startswith(f"_draft-{self.job}"):
                store.delete_file(i.path)


class RecordDataSource(DataSource):
    """`spark.read.format("recframe")`, `df.write.format("recframe")`, `spark.readStream.format("recframe")`."""

    @classmethod
    def name(cls) -> str:
        return "recframe"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushedReader if _true(self.options.get("pushdown")) else RecordReader)(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), schema, overwrite)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        from recframe.streaming.tail import TailReader

        return TailReader(dict(self.options))
