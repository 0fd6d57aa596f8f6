"""Writing record files: a folder with one file a task, or a single file."""

from __future__ import annotations

import logging
import mmap
import os
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from recframe.errors import RecordError, Refused, SpecError
from recframe.functions.boundary import Boundary, Separated
from recframe.operators.publish import add_file, exists, is_local, local, replace
from recframe.plans.framing import FrameCutter, Framing
from recframe.plans.indexing import derive_per_frame, with_frames, with_record_index, with_sized_frames
from recframe.session import register, shared_dir
from recframe.sources.container import FrameTable, encode_frame, filesystem, seek_table
from recframe.sources.records import run_of


log = logging.getLogger("recframe")


def write_folder(df: DataFrame, path: str, *order_by: str, boundary: Boundary | None = None, mode: str = "append", extension: str = "bin", **framing) -> None:
    """Every task writes a whole record file; read as a folder they are one run of indices in the given order.

    df has a record column. mode: append adds files after those there, overwrite replaces them.
    """
    register(df.sparkSession)
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in framing.items() if v is not None}
    df.select("record").write.format("recframe").mode(mode).options(**(boundary or Separated(b"\n")).options(), **options, extension=extension).save(path)


def _encode_frames(batches, level: int, checksum: bool) -> Iterator[tuple[int, bytes, int]]:
    """frame, content as it is stored, decompressed size."""
    held, frame = [], None

    def done() -> tuple[int, bytes, int]:
        data = b"".join(held)
        return frame, encode_frame(data, level, checksum), len(data)

    for batch in batches:
        frames = batch.column("frame").to_numpy()
        data, ends = run_of(batch.column("record").fill_null(b""))
        firsts = np.flatnonzero(np.concatenate([[True], frames[1:] != frames[:-1]])).tolist() if len(frames) else []
        for a, b in zip(firsts, [*firsts[1:], len(frames)]):
            if frames[a] != frame and held:
                yield done()
                held = []
            frame = int(frames[a])
            held.append(bytes(data[ends[a - 1] if a else 0 : ends[b - 1]]))
    if held:
        yield done()


def _write_part(batches, folder: str, level: int, checksum: bool) -> Iterator[pa.RecordBatch]:
    """A task's frames in a file of the shared folder; its path and the frames' sizes, as in a seek table, are all that leaves the task."""
    frames = _encode_frames(batches, level, checksum)
    first = next(frames, None)
    if first is None:
        return
    store, inner = filesystem(folder)
    name, sizes = uuid4().hex, []
    with store.open_output_stream(f"{inner}/{name}", compression=None) as out:
        for _, raw, size in chain([first], frames):
            out.write(raw)
            sizes.append((len(raw), size))
    yield pa.RecordBatch.from_pydict({"frame": pa.array([first[0]], pa.int32()), "part": pa.array([f"{folder}/{name}"]), "sizes": pa.array([np.array(sizes, "<u4").tobytes()], pa.binary())})


def encoded_parts(framed: DataFrame, folder: str, level: int = 3, checksum: bool = True) -> list[tuple[str, np.ndarray]]:
    """Path and sizes (compressed, decompressed) of files that hold the frames of record_index, frame, record, in their order.

    Frames are independent, so they are encoded where they are dealt to, and stay in the folder that tasks and driver share.
    """
    store, inner = filesystem(folder)
    store.create_dir(inner, recursive=True)
    dealt = framed.select("record_index", "frame", "record").repartitionByRange("frame").sortWithinPartitions("record_index")
    rows = dealt.select("frame", "record").mapInArrow(lambda it: _write_part(it, folder, level, checksum), "frame int, part string, sizes binary").collect()
    return [(r["part"], np.frombuffer(r["sizes"], "<u4").reshape(-1, 2)) for r in sorted(rows, key=lambda r: r["frame"])]


def cut_runs(df: DataFrame, boundary: Boundary, *keep: str) -> DataFrame:
    """keep, at, record: one row a record, with its place from 0, of a df whose record column holds runs of records.

    Every run is cut where its row is, so no process walks all bytes. A run must end with a record; null and empty ones hold none.
    """

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("record").is_valid())
            data, ends = run_of(batch.column("record"))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            found = [boundary.ends(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            for cuts, size in zip(found, (ends - starts).tolist()):
                if (int(cuts[-1]) if len(cuts) else 0) != size:
                    raise Refused("a run of records ends within one")
            counts = np.array([len(cuts) for cuts in found], np.int64)
            offsets = np.concatenate([[0], *(cuts + a for cuts, a in zip(found, starts))]).astype(np.int32)
            record = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            run = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(run)) for c in keep), pa.array(at, pa.int32()), record], [*keep, "at", "record"])

    schema = StructType([*(df.schema[c] for c in keep), StructField("at", IntegerType()), StructField("record", BinaryType())])
    return df.select(*keep, F.col("record").cast("binary")).mapInArrow(cut, schema)


def write_file(df: DataFrame, path: str, *order_by: str, boundary: Boundary | None = None, force: bool = False, **options) -> Framing:
    """One record file. df has record, and record_index or something to order by; the cluster encodes, the driver only strings together
    files of frames, without taking records or frames as rows.

    An existing file is refused unless force. Gives the framing with the count that was used.
    """
    boundary, framing = boundary or Separated(b"\n"), Framing(**options)
    if exists(path) and not force:
        raise Refused(f"{path} exists: force would replace it")
    if "record_index" in df.columns and not order_by:
        indexed = df.select("record_index", "record")
    else:
        indexed = with_record_index(df.select("record", *(c for c in order_by if c != "record")), *order_by)
    longest = indexed.agg(F.max(F.octet_length("record")).alias("x")).first()["x"] or 0
    if (framing.records_per_frame is not None or not framing.uniform) and longest > framing.limit:
        raise Refused(f"a record of {longest} bytes is above the limit of {framing.limit}: raise frame_size or limit_multiplier")
    n = framing.records_per_frame or (derive_per_frame(indexed, framing.frame_size) if framing.uniform else None)
    framed = with_frames(indexed, n) if n else with_sized_frames(indexed, framing.frame_size)
    folder = shared_dir(df.sparkSession)
    parts = encoded_parts(framed, folder, framing.level, framing.checksum)

    def put(out) -> None:
        for part, sizes in parts:
            if add_file(part, out) != sizes[:, 0].sum(dtype=np.int64):
                raise RecordError(f"{part} isn't what its task wrote")
        table = np.concatenate([sizes for _, sizes in parts]) if parts else None
        if table is None:
            empty = encode_frame(b"", framing.level, framing.checksum)
            out.write(empty)
            table = np.array([(len(empty), 0)])
        out.write(seek_table(FrameTable(table[:, 0].astype(np.uint32), table[:, 1].astype(np.uint32))))

    replace(path, put)
    store, inner = filesystem(folder)
    store.delete_dir(inner)
    return Framing(framing.frame_size, n, framing.limit_multiplier, framing.uniform, framing.level, framing.checksum)


def _runs_of(view: memoryview, boundary: Boundary, chunk: int, pool: ThreadPoolExecutor) -> Iterator[tuple[memoryview, np.ndarray]]:
    """Runs of whole records with their ends, in order, of about `chunk` bytes; what is left at last has no end.

    A separator of one byte is found anywhere without knowing what comes before, so chunks are searched ahead by other threads;
    other boundaries are walked from the last end on.
    """
    size, at = len(view), 0
    if isinstance(boundary, Separated) and len(boundary.separator) == 1:
        ahead: deque = deque()
        for lo in range(0, size + 16 * chunk, chunk):
            if lo < size:
                ahead.append((lo, pool.submit(boundary.ends, view[lo : lo + chunk])))
            if ahead and (len(ahead) > 16 or lo >= size):
                first, found = ahead.popleft()
                ends = found.result()
                if len(ends):
                    ends = ends + first
                    yield view[at : int(ends[-1])], ends - at
                    at = int(ends[-1])
    else:
        reach = chunk
        while at < size:
            ends = boundary.ends(view[at : at + reach])
            if len(ends):
                yield view[at : at + int(ends[-1])], ends
                at += int(ends[-1])
                reach = chunk
            elif at + reach >= size:
                break
            else:
                reach *= 2
    if at < size:
        yield view[at:], np.zeros(0, np.int64)


def compress(source: str, target: str | None = None, boundary: Boundary | None = None, remove: bool = False, chunk: int = 4 << 20, **options) -> Framing:
    """A plain local file as a record file (default: beside it, with .seek.zst after its name), in one pass and bounded memory.

    The source is mapped, not read into memory; frames are encoded by threads and written in order.
    """
    boundary, framing = boundary or Separated(b"\n"), Framing(**options)
    target = target or f"{source}.seek.zst"
    if is_local(target) and os.path.abspath(local(source)) == os.path.abspath(local(target)):
        raise SpecError("the output would replace the input")

    def put(out) -> int | None:
        cutter, sizes = FrameCutter(framing), []
        with open(local(source), "rb") as f, ThreadPoolExecutor() as pool:
            empty = not os.fstat(f.fileno()).st_size
            view = memoryview(b"" if empty else mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
            waiting: deque = deque()  # frames that are being encoded, in order

            def write(frames, left: int = 64) -> None:
                waiting.extend((len(data), pool.submit(encode_frame, data, framing.level, framing.checksum)) for data, _ in frames)
                while len(waiting) > left:
                    size, raw = waiting.popleft()
                    out.write(raw.result())
                    sizes.append((len(raw.result()), size))

            for run, ends in _runs_of(view, boundary, chunk, pool):
                write(cutter.feed(run, ends) if len(ends) else cutter.add(run))
            write(cutter.finish(), 0)
            if not sizes:
                write([(b"", 0)], 0)
        out.write(seek_table(FrameTable(*(np.array(x, np.uint32) for x in zip(*sizes)))))
        return cutter.per_frame

    n = replace(target, put)
    log.info("%s compressed, %s records a frame", source, n)
    if remove:
        os.unlink(local(source))
    return Framing(framing.frame_size, n or framing.records_per_frame, framing.limit_multiplier, framing.uniform, framing.level, framing.checksum)
