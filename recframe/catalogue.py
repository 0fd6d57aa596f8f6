"""The registered queries, each through real record files, and the SQL that gives the same rows.

The files are made once for a session and a data folder, in the shared folder, from the driver's tables. They are bounded by
those tables' size; a query reads the frames that its range needs.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recframe import cli
from recframe.errors import RecordError
from recframe.functions import codec
from recframe.functions.boundary import Boundary, Custom, Fixed, LengthPrefixed, MessagePack, Separated, resolve
from recframe.operators import edit
from recframe.operators.publish import exists, local, lock, pieces, replace
from recframe.operators.read import Handle
from recframe.operators.save import open_path, records_of_bytes, save
from recframe.operators.write import compress, cut_runs, write_file, write_folder
from recframe.plans import logical
from recframe.plans.framing import FrameCutter, Framing
from recframe.plans.indexing import derive_per_frame, frame_table, with_frames
from recframe.session import shared_dir
from recframe.sources.container import FrameTable, encode_frame, filesystem, seek_table
from recframe.sources.layout import RecordFile

N = 64
NEWLINE = Separated(b"\n")
_made: dict[tuple, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    """The path of a file that `make` writes, the first time it's asked for in this session."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _made:
        folder = shared_dir(spark)
        store, inner = filesystem(folder)
        store.create_dir(inner, recursive=True)
        make(f"{folder}/{name}")
        _made[key] = f"{folder}/{name}"
    return _made[key]


def event_records(spark: SparkSession, sf_dir: str, separator: bytes = b"\n") -> DataFrame:
    value = F.concat_ws("|", "event_id", "user_id", "event_type").cast("binary")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("record_index"), F.concat(value, F.lit(separator)).alias("record"))


def events(spark: SparkSession, sf_dir: str, boundary: Boundary = NEWLINE, n: int | None = N, **options) -> Handle:
    """events as a record file; n None: the count that the frame size gives."""
    name = f"events-{boundary.separator.hex()}-{n}-{options.get('frame_size', 0)}.txt.seek.zst"
    path = _once(spark, sf_dir, name, lambda p: write_file(event_records(spark, sf_dir, boundary.separator), p, boundary=boundary, records_per_frame=n, **options))
    return Handle(spark, path, boundary)


def _text(df: DataFrame) -> DataFrame:
    return df.select("record_index", codec.text(codec.strip_separator("record", b"\n")).alias("value"))


def _groups(path: str, groups: list[bytes]) -> str:
    """A file with exactly these frames, uneven or not."""
    raw = [encode_frame(g) for g in groups]
    table = seek_table(FrameTable(np.array([len(x) for x in raw], np.uint32), np.array([len(g) for g in groups], np.uint32)))
    replace(path, lambda out: out.write(b"".join(raw) + table))
    return path


def _copied(source: str, target: str) -> None:
    def put(out) -> None:
        for data in pieces(source, 0, 1 << 62):
            out.write(data)

    replace(target, put)


def _drifting(spark: SparkSession, sf_dir: str) -> str:
    lines = [f"line {i}\n".encode() for i in range(34)]
    return _once(spark, sf_dir, "drifting.txt.seek.zst", lambda p: _groups(p, [b"".join(lines[a:b]) for a, b in ((0, 10), (10, 14), (14, 24), (24, 34))]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("value", r"\|")
    return range_of(100, 100)(spark, sf_dir).select("record_index", F.get(parts, F.lit(0)).cast("long").alias("event_id"), F.get(parts, F.lit(1)).cast("long").alias("user_id"), F.get(parts, F.lit(2)).alias("event_type"))


# ---------------------------------------------------------------- reads


def range_of(start: int, count: int | None):
    return lambda spark, sf_dir: _text(events(spark, sf_dir).records(start, count))


def scan_all(spark, sf_dir):
    return _text(events(spark, sf_dir).scan())


def scan_pushed(spark, sf_dir):
    return _text(events(spark, sf_dir).scan().where("record_index >= 130 AND record_index < 333"))


def lookup_missing(spark, sf_dir):
    assert events(spark, sf_dir).record(10**9) is None
    return _text(events(spark, sf_dir).scan().where(F.col("record_index") == 10**9))


def range_past_end_clipped(spark, sf_dir):
    h = events(spark, sf_dir)
    return _text(h.records(h.total() - 10, 500))


def tail_n(spark, sf_dir):
    return _text(events(spark, sf_dir).tail(25))


def skip_take(spark, sf_dir):
    return _text(events(spark, sf_dir).slice(40, 65))


def reverse_tail(spark, sf_dir):
    return events(spark, sf_dir).reverse(50).select("record_index", codec.text(codec.strip_separator("record", b"\n")).alias("value"), "rev")


def filter_contains(spark, sf_dir):
    return scan_all(spark, sf_dir).where(F.contains("value", F.lit("purchase")))


def filter_map_take(spark, sf_dir):
    found = filter_contains(spark, sf_dir).orderBy("record_index").limit(10)
    return found.select("record_index", F.split_part("value", F.lit("|"), F.lit(3)).alias("event_type"))


def fold_bytes(spark, sf_dir):
    return events(spark, sf_dir).scan().agg(F.sum(F.octet_length("record")).cast("long").alias("bytes"), F.max(F.octet_length("record")).cast("long").alias("longest"))


def fold_ordered(spark, sf_dir):
    """The fold keeps order: a running digest of the first 300 records' lengths."""
    x = events(spark, sf_dir).fold(lambda a, r: (a * 31 + len(r)) % 1000003, 7, 0, 300)
    return spark.range(1).select(F.lit(x).cast("long").alias("digest"))


def total_records(spark, sf_dir):
    return spark.range(1).select(F.lit(events(spark, sf_dir).total()).cast("long").alias("records"))


def points(spark, sf_dir):
    h = events(spark, sf_dir)
    return spark.createDataFrame([(i, h.get(i)) for i in (0, 63, 64, 321, h.total() - 1)], "record_index long, value string")


def shard_scan(spark, sf_dir):
    """Four workers' shares, each read by itself."""
    h, out = events(spark, sf_dir), None
    for i in range(4):
        own = h.shard(i, 4).agg(F.lit(i).cast("long").alias("shard"), F.count("*").alias("n"), F.min("record_index").alias("first"), F.max("record_index").alias("last"))
        out = own if out is None else out.unionAll(own)
    return out


def from_frame(spark, sf_dir):
    return _text(events(spark, sf_dir).from_frame(9))


def where_length_select(spark, sf_dir):
    return scan_all(spark, sf_dir).where(F.split_part("value", F.lit("|"), F.lit(3)) == "click").agg(F.count("*").alias("n"))


def uniq_counts(spark, sf_dir):
    return scan_all(spark, sf_dir).groupBy(F.split_part("value", F.lit("|"), F.lit(3)).alias("event_type")).agg(F.count("*").alias("n"))


def text_source_agrees(spark, sf_dir):
    """Any zstd reader gives the same lines, in one partition and without an index."""
    lines = spark.read.text(events(spark, sf_dir).paths[0])
    return lines.select(F.col("value"))


def positional_join(spark, sf_dir):
    left, right = scan_all(spark, sf_dir), _text(orders(spark, sf_dir).scan()).withColumnRenamed("value", "order_value")
    return left.join(right, "record_index").select("record_index", "value", "order_value")


# ---------------------------------------------------------------- layout


def frame_layout(separator: bytes):
    def query(spark, sf_dir):
        boundary = Separated(separator)
        rows = events(spark, sf_dir, boundary).inspect(fast=False)
        return rows.select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"), "decomp_start", "decomp_end", "decomp_size")

    return query


def frame_layout_fast(spark, sf_dir):
    return events(spark, sf_dir).inspect(fast=True).select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"))


def auto_n(spark, sf_dir):
    return spark.range(1).select(F.lit(events(spark, sf_dir, n=None, frame_size=16384).layout.files[0].per_frame).cast("long").alias("n"))


def frames_auto_n(spark, sf_dir):
    return events(spark, sf_dir, n=None, frame_size=16384).inspect(fast=False).select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"), "decomp_size")


def frames_logical(spark, sf_dir):
    """The same table from expressions alone."""
    rows = event_records(spark, sf_dir)
    return frame_table(with_frames(rows, derive_per_frame(rows, 16384))).select(F.col("frame").cast("long").alias("frame"), "cnt", "decomp_size")


def size_mode_frames(spark, sf_dir):
    h = events(spark, sf_dir, n=None, frame_size=4000, uniform=False)
    return h.inspect(fast=False).select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"), "decomp_size")


def verify_uniform(spark, sf_dir):
    return events(spark, sf_dir).verify().select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"))


def verify_drift(spark, sf_dir):
    return Handle(spark, _drifting(spark, sf_dir)).verify().select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"))


def drift_misplaced_index(spark, sf_dir):
    """Division places records wrongly in an uneven file, and says nothing: what each index up to the supposed total gives."""
    h = Handle(spark, _drifting(spark, sf_dir))
    return spark.createDataFrame([(i, h.get(i, optional=True)) for i in range(h.total())], "record_index long, value string")


def drift_exact_scan(spark, sf_dir):
    """Positions don't."""
    return _text(Handle(spark, _drifting(spark, sf_dir), index_mode="exact").records(8, 20))


def handle_summary(spark, sf_dir):
    h = Handle(spark, [events(spark, sf_dir).paths[0], orders(spark, sf_dir).paths[0]])
    file = F.when(F.col("path") == h.paths[0], 1).otherwise(2).cast("long").alias("file")
    return h.summary().select(file, "finder", "frames", "records_per_frame", "records")


# ---------------------------------------------------------------- several files


def orders(spark: SparkSession, sf_dir: str) -> Handle:
    def make(path: str) -> None:
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus").cast("binary"), F.lit(b"\n")).alias("record"))
        write_file(rows, path, "o_orderkey", records_per_frame=100)

    return Handle(spark, _once(spark, sf_dir, "orders.txt.seek.zst", make))


def both(spark: SparkSession, sf_dir: str) -> Handle:
    return Handle(spark, [events(spark, sf_dir).paths[0], orders(spark, sf_dir).paths[0]])


def multi_file_scan(spark, sf_dir):
    h = both(spark, sf_dir)
    return h.scan().select(F.col("file_index").cast("long").alias("file"), "record_index", codec.text(codec.strip_separator("record", b"\n")).alias("value"))


def multi_file_range(spark, sf_dir):
    h = both(spark, sf_dir)
    return _text(h.records(h.layout.offset(1) - 5, 15))


def folder_scan(spark, sf_dir):
    """A folder that every task wrote a file of, read as one run of indices in the order of event_id."""

    def make(path: str) -> None:
        write_folder(event_records(spark, sf_dir).repartition(4), path, "record_index", records_per_frame=N, extension="txt")

    return _text(Handle(spark, _once(spark, sf_dir, "events-folder", make)).scan())


def conversations_handle(spark, sf_dir):
    """One file a role, as one run of indices."""
    table = _table(spark, sf_dir, "conversations")
    roles = sorted(r["role"] for r in table.select("role").where("role IS NOT NULL").distinct().collect())

    def make(role: str) -> Callable[[str], None]:
        rows = table.where(F.col("role") == role).select("conv_id", "turn", F.concat(F.concat_ws("|", "role", "conv_id", "turn").cast("binary"), F.lit(b"\n")).alias("record"))
        return lambda path: write_file(rows, path, "conv_id", "turn", records_per_frame=50)

    paths = [_once(spark, sf_dir, f"conversations-{i}-{role}.txt.seek.zst", make(role)) for i, role in enumerate(roles)]
    return _text(Handle(spark, paths).scan())


# ---------------------------------------------------------------- edits


def _copy(spark: SparkSession, sf_dir: str, name: str, change: Callable[[str], None], source: Handle | None = None) -> Handle:
    """A changed copy of the events file (or another); change gets its path."""

    def make(path: str) -> None:
        _copied((source or events(spark, sf_dir)).paths[0], path)
        change(path)

    return Handle(spark, _once(spark, sf_dir, f"{name}.txt.seek.zst", make))


def truncate_k(spark, sf_dir):
    return _text(_copy(spark, sf_dir, "truncated", lambda p: edit.truncate(p, N * 7)).scan())


def truncate_logical(spark, sf_dir):
    return _text(logical.truncate(events(spark, sf_dir).scan(), N * 7))


def _appended(spark: SparkSession, sf_dir: str) -> Handle:
    return _copy(spark, sf_dir, "appended", lambda p: edit.append_records(p, orders(spark, sf_dir).cat(0, 100)))


def append_records(spark, sf_dir):
    h = _appended(spark, sf_dir)
    return _text(h.records(h.total() - 130))


def append_frame_counts(spark, sf_dir):
    return _appended(spark, sf_dir).inspect(fast=False).select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"), "decomp_size")


def append_changed_frames(spark, sf_dir):
    """Frames whose bytes an append changed: those from the last one on, if it wasn't full."""
    before, after = events(spark, sf_dir).layout.files[0], _appended(spark, sf_dir).layout.files[0]
    same = lambda i: i < before.frames and before.frame_bytes(i) == after.frame_bytes(i) and before.table.compressed[i] == after.table.compressed[i]
    return spark.createDataFrame([(i,) for i in range(after.frames) if not same(i)], "frame long")


def _frames_joined(spark: SparkSession, sf_dir: str) -> Handle:
    source = events(spark, sf_dir).paths[0]

    def change(path: str) -> None:
        edit.copy_range(source, path, N * 2, N * 3)
        edit.append_frames(path, source, N * 10, N * 2, check_every_frame=True)

    return _copy(spark, sf_dir, "joined", change)


def append_frames_join(spark, sf_dir):
    return _text(_frames_joined(spark, sf_dir).scan())


def copy_range(spark, sf_dir):
    source = events(spark, sf_dir).paths[0]
    return _text(_copy(spark, sf_dir, "copied", lambda p: edit.copy_range(source, p, N * 3, N * 6)).scan())


def copy_range_logical(spark, sf_dir):
    return _text(logical.copy_range(events(spark, sf_dir).scan(), N * 3, N * 6))


def split_rejoin(spark, sf_dir):
    def change(path: str) -> None:
        edit.split(path, N * 8, f"{path}.tail")
        edit.append_frames(path, f"{path}.tail")

    return _text(_copy(spark, sf_dir, "rejoined", change).scan())


def split_update_rejoin(spark, sf_dir):
    """The middle cut out, its records changed and encoded anew with as many a frame, all joined again."""
    source = events(spark, sf_dir)

    def change(path: str) -> None:
        middle, tail = f"{path}.middle", f"{path}.tail"
        edit.copy_range(source.paths[0], tail, N * 6, None, aligned=False)
        edit.truncate(path, N * 4)
        rows = source.records(N * 4, N * 2).select((F.col("record_index") - N * 4).alias("record_index"), F.concat(F.lit(b"new "), F.col("record")).alias("record"))
        write_file(rows, middle, records_per_frame=N)
        edit.append_frames(path, middle)
        edit.append_frames(path, tail)

    return _text(_copy(spark, sf_dir, "updated", change).scan())


def insert_separator(spark, sf_dir):
    """A file that ends with a fragment: refused, or completed."""

    def make(path: str) -> None:
        _groups(path, [b"a\nb\n", b"c\nd\n", b"e\npart"])

    def change(path: str) -> None:
        try:
            edit.append_records(path, b"f\n")
            raise AssertionError("a fragment was appended to")
        except RecordError:
            edit.append_records(path, b"f\n", insert_separator=True)

    h = Handle(spark, _once(spark, sf_dir, "fragment.txt.seek.zst", make))
    return _text(_copy(spark, sf_dir, "completed", change, h).scan())


# ---------------------------------------------------------------- values


def _props(spark: SparkSession, sf_dir: str) -> Handle:
    def make(path: str) -> None:
        write_file(codec.encode(_table(spark, sf_dir, "events").select(F.col("event_id").alias("record_index"), "props"), column="props", keep=("record_index",)), path)

    return Handle(spark, _once(spark, sf_dir, "props.jsonl.seek.zst", make))


def json_decode(spark, sf_dir):
    return _props(spark, sf_dir).values(schema="k long").select("record_index", F.col("value.k").alias("k"))


def json_variant(spark, sf_dir):
    return _props(spark, sf_dir).values().select("record_index", F.variant_get("value", "$.k", "long").alias("k"))


def json_encode_lines(spark, sf_dir):
    """Rows to JSON records and back to text."""

    def make(path: str) -> None:
        rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("record_index"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user")).alias("inner"))
        write_file(codec.encode(rows, "json", keep=("record_index",)), path)

    return _text(Handle(spark, _once(spark, sf_dir, "seq.jsonl.seek.zst", make)).scan())


def json_deep_path(spark, sf_dir):
    rows = json_encode_lines(spark, sf_dir)
    return rows.select("record_index", F.get_json_object("value", "$.inner.user").cast("long").alias("user"))


def strip_and_terminate(spark, sf_dir):
    rows = spark.createDataFrame([("a\n",), ("a",), ("",), ("\n",), ("a\n\n",)], "value string").select("value", F.col("value").cast("binary").alias("record"))
    return rows.select("value", codec.strip_separator("record", b"\n").cast("string").alias("stripped"), codec.terminate("record", b"\n").cast("string").alias("terminated"))


# ---------------------------------------------------------------- other boundaries


def _little(x: F.Column, size: int = 4) -> F.Column:
    """A number as so many bytes, the least first."""
    return F.unhex(F.concat(*(F.substring(F.lpad(F.hex(x), 2 * size, "0"), 2 * (size - i) - 1, 2) for i in range(size))))


def fixed_records(spark, sf_dir):
    """embeddings as 256-byte records of 64 floats; their bytes read again."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([np.array(x, "<f4").tobytes() for x in b.column("embedding").to_pylist()], pa.binary())], ["record_index", "record"])

    def make(path: str) -> None:
        rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(pack, "record_index long, record binary")
        write_file(rows, path, boundary=Fixed(256), records_per_frame=100)

    def unpack(batches):
        import pyarrow as pa

        for b in batches:
            x = np.frombuffer(b"".join(b.column("record").to_pylist()), "<f4").reshape(-1, 64)
            yield pa.RecordBatch.from_arrays([b.column("record_index"), pa.array(x[:, 0]), pa.array(x[:, 63])], ["record_index", "first", "last"])

    h = Handle(spark, _once(spark, sf_dir, "embeddings.bin.seek.zst", make), Fixed(256))
    return h.scan().select("record_index", "record").mapInArrow(unpack, "record_index long, first float, last float")


def _documents(spark: SparkSession, sf_dir: str) -> Handle:
    def make(path: str) -> None:
        body = F.col("text").cast("binary")
        rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(_little(F.octet_length(body)), body).alias("record"))
        write_file(rows, path, "doc_id", boundary=LengthPrefixed(), records_per_frame=32)

    return Handle(spark, _once(spark, sf_dir, "documents.fb.seek.zst", make), LengthPrefixed())


def le32_records(spark, sf_dir):
    rows = _documents(spark, sf_dir).scan()
    return rows.select("record_index", F.octet_length("record").cast("long").alias("bytes"), F.md5(F.substring("record", F.lit(5), F.octet_length("record"))).alias("body_md5"))


def wrong_boundary_disagrees(spark, sf_dir):
    """The same frames under the right boundary and under newlines: other records, and no error."""
    h = _documents(spark, sf_dir)
    right = h.inspect(fast=False).agg(F.sum("cnt_of_sep").alias("right"))
    wrong = Handle(spark, h.paths, NEWLINE).inspect(fast=False).agg(F.sum("cnt_of_sep").alias("wrong"))
    return spark.range(1).select(right.scalar().cast("long").alias("right"), wrong.scalar().cast("long").alias("wrong"))


def msgpack_records(spark, sf_dir):
    """[id, text] values of conversations: an array of two, an unsigned integer and a string, each with 32-bit lengths."""

    def make(path: str) -> None:
        number = F.lpad(F.hex("conv_id"), 16, "0")
        body = F.col("text").cast("binary")
        rows = _table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.concat(F.unhex(F.concat(F.lit("92CF"), number, F.lit("DB"), F.lpad(F.hex(F.octet_length(body)), 8, "0"))), body).alias("record"))
        write_file(rows, path, "conv_id", "turn", boundary=MessagePack(), records_per_frame=50)

    h = Handle(spark, _once(spark, sf_dir, "conversations.msgpack.seek.zst", make), MessagePack())
    return h.scan().select("record_index", F.conv(F.substring(F.hex("record"), 5, 16), 16, 10).cast("long").alias("conv_id"), F.octet_length("record").cast("long").alias("bytes"))


def overlap_separator(spark, sf_dir):
    """Whole records and wholeness of 'a' and up to six newlines under a separator of two."""
    double = Separated(b"\n\n")
    rows = [(k, double.count(b"a" + b"\n" * k), double.ends_whole(b"a" + b"\n" * k)) for k in range(7)]
    return spark.createDataFrame(rows, "k long, records long, whole boolean")


def documents_sep_multi(spark, sf_dir):
    separator = b"\x00-=-\x00"

    def make(path: str) -> None:
        rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text").cast("binary"), F.lit(separator)).alias("record"))
        write_file(rows, path, "doc_id", boundary=Separated(separator), records_per_frame=32)

    h = Handle(spark, _once(spark, sf_dir, "documents.sep.seek.zst", make), Separated(separator))
    return h.scan().select("record_index", F.md5(codec.strip_separator("record", separator)).alias("text_md5"))


def frame_cutter(spark, sf_dir):
    """Ten records, one by one, cut into frames of three."""
    cutter = FrameCutter(Framing(records_per_frame=3))
    frames = [f for i in range(10) for f in cutter.add(b"%d\n" % i)] + list(cutter.finish())
    return spark.createDataFrame([(i, n, len(data)) for i, (data, n) in enumerate(frames)], "frame long, records long, bytes long")


def binary_file_records(spark, sf_dir):
    """The same records from the file's bytes as a row."""
    rows = records_of_bytes(spark.read.format("binaryFile").load(events(spark, sf_dir).paths[0]))
    return _text(rows)


def count_in_buffers(spark, sf_dir):
    """Lines of documents that end, counted by an expression."""
    return _table(spark, sf_dir, "documents").select("doc_id", codec.count_separators("text", b"\n").alias("ended"), codec.count_separators("text", b"\n\n").alias("blank"))


def save_and_append(spark, sf_dir):
    """Rows saved as JSON records in two steps."""

    def make(path: str) -> None:
        rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        save(rows.where("n_nationkey < 10"), path, "n_nationkey", records_per_frame=4)
        save(rows.where("n_nationkey >= 10"), path, "n_nationkey", append=True)

    h = open_path(spark, _once(spark, sf_dir, "nation.jsonl.seek.zst", make))
    return h.values(schema="n_nationkey int, n_name string").select("record_index", F.col("value.n_nationkey").alias("n_nationkey"), F.col("value.n_name").alias("n_name"))


def stream_scan(spark, sf_dir):
    """A record file as a stream, its last frame too, into a table that is read back."""
    out = shared_dir(spark)
    stream = spark.readStream.format("recframe").options(path=events(spark, sf_dir).paths[0], include_tail="true").load()
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return _text(spark.read.parquet(f"{out}/rows"))


def stream_to_folder(spark, sf_dir):
    """A stream of rows into a folder of record files, a file a batch."""
    from recframe.streaming.sink import to_folder

    table = f"{sf_dir}/events.parquet"

    def make(path: str) -> None:
        schema = spark.read.parquet(table).schema
        rows = spark.readStream.schema(schema).parquet(f"{table}*" if os.path.isfile(local(table)) else table)
        record = F.concat(F.concat_ws("|", "event_id", "user_id", "event_type").cast("binary"), F.lit(b"\n")).alias("record")
        q = to_folder(rows.select("event_id", record), path, "event_id", records_per_frame=N).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        q.awaitTermination()

    return _text(Handle(spark, _once(spark, sf_dir, "events-stream", make)).scan())


# ---------------------------------------------------------------- streams of bytes, patterns, pipes


def byte_stream(spark, sf_dir):
    """All bytes of the file, a frame at a time."""
    digest = hashlib.md5()
    size = 0
    for chunk in events(spark, sf_dir).chunks():
        digest.update(chunk)
        size += len(chunk)
    return spark.createDataFrame([(size, digest.hexdigest())], "bytes long, md5 string")


def range_streamed(spark, sf_dir):
    """A range over many frames, written as it is decoded."""
    out = io.BytesIO()
    events(spark, sf_dir).write_to(out, 100, 500)
    lines = out.getvalue().decode().splitlines()
    return spark.createDataFrame(list(enumerate(lines, 100)), "record_index long, value string")


def _plain(spark: SparkSession, sf_dir: str) -> str:
    """events as a plain file of lines on this machine's disk, for what takes one."""

    def make(path: str) -> None:
        replace(path, events(spark, sf_dir).write_to)

    return local(_once(spark, sf_dir, "events.txt", make))


def _command(*argv: object, stdin: bytes = b"") -> bytes:
    out = io.BytesIO()
    cli.run([str(a) for a in argv], io.BytesIO(stdin), out)
    return out.getvalue()


def _lines(spark: SparkSession, raw: bytes, first: int = 0) -> DataFrame:
    return spark.createDataFrame(list(enumerate(raw.decode().splitlines(), first)), "record_index long, value string")


def glob_scan(spark, sf_dir):
    """Files that a pattern names, in the order of their names, as one run of indices."""

    def make(path: str) -> None:
        h = events(spark, sf_dir)
        for i, (start, count) in enumerate(((0, N * 4), (N * 4, N * 3), (N * 7, None))):
            edit.copy_range(h.paths[0], f"{path}-{i}.txt.seek.zst", start, count, aligned=False)
        replace(path, lambda out: out.write(b"not a record file"))

    return _text(Handle(spark, f"{local(_once(spark, sf_dir, 'pattern', make))}-*.txt.seek.zst").scan())


def many_files(spark, sf_dir):
    """More files than the driver opens itself: tasks open them, in the given order."""

    def make(path: str) -> None:
        for i in range(300):
            _groups(f"{path}-{i:03d}.seek.zst", [b"%d %d\n" % (i, k) for k in range(1 + i % 3)])

    base = _once(spark, sf_dir, "many", make)
    h = Handle(spark, [f"{base}-{i:03d}.seek.zst" for i in range(300)])
    return _text(h.records(7, 200))


def compress_file(spark, sf_dir):
    """A plain file compressed in one pass: the frames that its size gives."""

    def make(path: str) -> None:
        compress(_plain(spark, sf_dir), local(path), frame_size=16384)

    return Handle(spark, _once(spark, sf_dir, "compressed.txt.seek.zst", make)).inspect(fast=False).select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"), "decomp_size")


def compress_long_records(spark, sf_dir):
    """A record above the limit, before the count of frame 0 is known, settles it; with a given count it is refused."""
    body = [b"short %d\n" % i for i in range(5)] + [b"x" * 5000 + b"\n"] + [b"after %d\n" % i for i in range(9)]

    def make(path: str) -> None:
        replace(f"{path}.in", lambda out: out.write(b"".join(body)))
        framing = compress(f"{local(path)}.in", local(path), frame_size=1000, limit_multiplier=2)
        assert framing.records_per_frame == 5
        try:
            compress(f"{local(path)}.in", f"{local(path)}.none", frame_size=1000, limit_multiplier=2, records_per_frame=4)
            raise AssertionError("a record above the limit was taken")
        except RecordError:
            assert not exists(f"{path}.none")

    h = Handle(spark, _once(spark, sf_dir, "long.txt.seek.zst", make))
    return h.inspect(fast=False).select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"), "decomp_size")


def shard_multi_file(spark, sf_dir):
    """Shares of the frames of two files: together they are every record once."""
    h, out = both(spark, sf_dir), None
    for i in range(4):
        own = h.shard(i, 4).agg(F.lit(i).cast("long").alias("shard"), F.count("*").alias("n"), F.min("record_index").alias("first"), F.max("record_index").alias("last"))
        out = own if out is None else out.unionAll(own)
    return out


def from_frame_multi_file(spark, sf_dir):
    """A view from a frame of the second file on."""
    h = both(spark, sf_dir)
    return _text(h.from_frame(h.layout.files[0].frames + 2))


def exact_past_end(spark, sf_dir):
    """Counted positions refuse what is past the end, as division does."""
    h, out = Handle(spark, _drifting(spark, sf_dir), index_mode="exact"), []
    for start in (33, 34, 35, 100):
        try:
            out.append((start, h.records(start).count()))
        except RecordError:
            out.append((start, -1))
    return spark.createDataFrame(out, "start long, records long")


def exact_total(spark, sf_dir):
    return spark.range(1).select(F.lit(Handle(spark, _drifting(spark, sf_dir), index_mode="exact").total()).cast("long").alias("records"))


def reverse_scan(spark, sf_dir):
    """Every record, last first: in the order of the rows as they come."""
    rows = events(spark, sf_dir).reverse().withColumn("at", F.monotonically_increasing_id())
    return rows.where("rev < 300").select("record_index", "rev", codec.text(codec.strip_separator("record", b"\n")).alias("value"))


def verified_scan(spark, sf_dir):
    """Every frame is judged while it is read."""
    return _text(Handle(spark, events(spark, sf_dir).paths, verify=True).scan())


def verified_lookups(spark, sf_dir):
    """What a verifying reader gives and refuses in an uneven file: frames hold 10, 4, 10 and 10 records."""
    h, out = Handle(spark, _drifting(spark, sf_dir), verify=True), []
    for i in (0, 9, 11, 13, 14, 19, 20):
        try:
            out.append((i, (h.record(i) or b"").decode().strip(), False))
        except RecordError:
            out.append((i, None, True))
    return spark.createDataFrame(out, "record_index long, value string, refused boolean")


def count_frames_range(spark, sf_dir):
    return events(spark, sf_dir).count_frames(3, 9).select(F.col("frame").cast("long").alias("frame"), F.col("cnt_of_sep").alias("cnt"))


def frame_rows(spark, sf_dir):
    """The listing of frames under the names that a table view uses."""
    return events(spark, sf_dir).frame_rows(fast=False).select(F.col("index").cast("long").alias("index"), "decomp_start", "decomp_end", "decomp_size", "records")


def frame_checksums(spark, sf_dir):
    """Which frames carry a checksum: those of a file written without, and those appended to one written with."""

    def make(path: str) -> None:
        write_file(event_records(spark, sf_dir).where("record_index < 200"), path, records_per_frame=N, checksum=False)

    without = Handle(spark, _once(spark, sf_dir, "unchecked.txt.seek.zst", make)).checksums().select(F.lit("without").alias("file"), F.col("frame").cast("long").alias("frame"), "checksum")
    with_them = events(spark, sf_dir).checksums().where("frame < 4").select(F.lit("with").alias("file"), F.col("frame").cast("long").alias("frame"), "checksum")
    return without.unionAll(with_them)


def corrupt_frame(spark, sf_dir):
    """A flipped byte: reads of its frame fail, reads of others don't."""

    def make(path: str) -> None:
        _copied(events(spark, sf_dir).paths[0], path)
        file = RecordFile(path)
        at = int(file.table.compressed[:2].sum()) - 2  # within frame 1's checksum
        raw = bytearray(b"".join(pieces(path, 0, 1 << 62)))
        raw[at] ^= 1
        replace(path, lambda out: out.write(raw))

    h, out = Handle(spark, _once(spark, sf_dir, "corrupt.txt.seek.zst", make)), []
    for i in (0, N, 2 * N):
        try:
            out.append((i, h.record(i).decode().strip(), False))
        except Exception as e:
            assert "checksum" in str(e)
            out.append((i, None, True))
    return spark.createDataFrame(out, "record_index long, value string, refused boolean")


# ---------------------------------------------------------------- the command line


def cli_compress_cat(spark, sf_dir):
    """compress, then cat, by their command lines."""

    def make(path: str) -> None:
        _command("compress", _plain(spark, sf_dir), local(path), "-c", N)

    return _lines(spark, _command("cat", local(_once(spark, sf_dir, "cli.txt.seek.zst", make)), "-f", 60, "-c", 100), 60)


def cli_compress_pipe(spark, sf_dir):
    """The same from a pipe, under the other name of the command."""

    def make(path: str) -> None:
        with open(_plain(spark, sf_dir), "rb") as f:
            _command("convert", "-", local(path), "-c", 50, "--no-check", "--level", 1, stdin=f.read())

    path = _once(spark, sf_dir, "pipe.txt.seek.zst", make)
    assert not Handle(spark, path).checksums().first()["checksum"]
    return _lines(spark, _command("cat", local(path), "--cnt", 1 << 40))


def cli_inspect(spark, sf_dir):
    rows = json.loads(_command("inspect", local(events(spark, sf_dir).paths[0]), "--format", "json", "--no-fast-mode"))
    assert _command("inspect", local(events(spark, sf_dir).paths[0])).count(b"\n") == len(rows)
    return spark.createDataFrame([(i, r["decomp_start"], r["decomp_size"], r["cnt_of_sep"]) for i, r in enumerate(rows)], "frame long, decomp_start long, decomp_size long, cnt long")


def cli_edits(spark, sf_dir):
    """truncate, append from a pipe, copy-range to stdout and append of its frames, by their command lines."""

    def make(path: str) -> None:
        target = local(path)
        _copied(events(spark, sf_dir).paths[0], path)
        _command("truncate", target, "--records", N * 4, "--copy")
        replace(f"{path}.part", lambda out: out.write(_command("copy-range", local(events(spark, sf_dir).paths[0]), "-", "--from", N * 8, "--cnt", N * 4)))
        _command("append", target, f"{target}.part", "--input-seekable", "--input-from", N, "--input-cnt", N * 2, "--check-input-frames")
        _command("append", target, "--records-per-frame", N, stdin=b"one\ntwo\n")

    return _lines(spark, _command("cat", local(_once(spark, sf_dir, "edited.txt.seek.zst", make)), "-c", 1 << 40))


def cli_flags(spark, sf_dir):
    """How flags name a boundary, and what is refused."""
    cases = [(None, None, None), ("\t", None, None), (None, "sep", "ab"), (None, "fixed", "12"), (None, "fixed", "0"), (None, "fixed", None), (None, "msgpack", None), (None, "msgpack", "1"), (None, "flatbuffers", None), (None, "nothing", None), ("a", "fixed", None), (None, None, "x"), ("", None, None)]
    out = []
    for case in cases:
        try:
            b = resolve(*case)
            out.append((*case, b.name, b.argument))
        except RecordError:
            out.append((*case, "refused", None))
    return spark.createDataFrame(out, "separator string, finder string, arg string, name string, parameter string")


# ---------------------------------------------------------------- more edits


def _outcome(run: Callable[[], object]) -> str:
    try:
        run()
        return "done"
    except RecordError as e:
        return type(e).__name__


def locked_writer(spark, sf_dir):
    """While a writer holds a file others are refused; a refused or failed one leaves the file as it was."""

    def make(path: str) -> None:
        _copied(events(spark, sf_dir).paths[0], path)

    path = local(_once(spark, sf_dir, "locked.txt.seek.zst", make))
    before = RecordFile(path).total
    with lock(path):
        held = _outcome(lambda: edit.truncate(path, N))
    out = [("held", held, RecordFile(path).total == before), ("off a frame's start", _outcome(lambda: edit.truncate(path, N + 1)), RecordFile(path).total == before)]
    out.append(("free", _outcome(lambda: edit.append_records(path, b"one\n")), RecordFile(path).total == before + 1))
    edit.truncate(path, N * 3)
    out.append(("cut", _outcome(lambda: edit.truncate(path, N * 2)), RecordFile(path).total == N * 2))
    os.unlink(path)
    _copied(events(spark, sf_dir).paths[0], path)
    return spark.createDataFrame(out, "writer string, outcome string, as_expected boolean")


def append_fixed(spark, sf_dir):
    """Records without a separator are appended by their boundary; a separator can't be inserted between them."""
    records = [b"%07d" % i for i in range(1000)]

    def make(path: str) -> None:
        _groups(path, [b"".join(records[a : a + 100]) for a in range(0, 600, 100)] + [b"".join(records[600:650])])
        assert _outcome(lambda: edit.append_records(path, b"0000000", Fixed(7), insert_separator=True)) == "Refused"
        assert _outcome(lambda: edit.append_records(path, b"000", Fixed(7))) == "Refused"
        edit.append_records(path, b"".join(records[650:]), Fixed(7))

    h = Handle(spark, _once(spark, sf_dir, "appended.bin.seek.zst", make), Fixed(7))
    return h.scan().select("record_index", F.col("record").cast("string").cast("long").alias("value"), F.col("frame").cast("long").alias("frame"))


def append_many(spark, sf_dir):
    """Appends that hand the layout on, that state the count, and that trust it: what each leaves."""
    steps: list[tuple] = []

    def make(path: str) -> None:
        _copied(events(spark, sf_dir).paths[0], path)
        edit.truncate(path, N * 3)
        first = edit.append_records(path, b"a\n" * 10)
        second = edit.append_records(path, b"b\n" * 60, previous=first)
        third = edit.append_records(path, b"c\n" * 5, records_per_frame=N)
        fourth = edit.append_records(path, b"d\n" * 3, records_per_frame=N, trust=True)
        steps.extend((i, x.records_per_frame, x.last_frame_records, len(x.table)) for i, x in enumerate((first, second, third, fourth)))
        assert _outcome(lambda: edit.append_records(path, b"e\n", records_per_frame=N - 1)) == "Refused"
        assert _outcome(lambda: edit.append_records(path, b"e\n", records_per_frame=N // 16, trust=True)) == "Refused"
        assert RecordFile(path).total == N * 3 + 78

    _once(spark, sf_dir, f"many-{len(_made)}.txt.seek.zst", make)
    return spark.createDataFrame(steps, "step long, per_frame long, last_frame long, frames long")


def append_stream(spark, sf_dir):
    """Records that come as a DataFrame, in any partitioning, are appended in the order of their indices."""

    def change(path: str) -> None:
        edit.append_records(path, event_records(spark, sf_dir).where("record_index < 150").repartition(5))

    h = _copy(spark, sf_dir, "streamed", change)
    return _text(h.records(events(spark, sf_dir).total()))


def trailing_empty_frames(spark, sf_dir):
    """Empty frames at the end, as some writers leave them, are no frames: reads, totals and appends skip them."""

    def make(path: str) -> None:
        _groups(path, [b"a\nb\n", b"c\nd\n", b"e\nf\n", b"g\n", b"", b""])
        edit.append_records(path, b"h\ni\n")

    h = Handle(spark, _once(spark, sf_dir, "trailing.txt.seek.zst", make))
    return h.scan().select("record_index", F.col("frame").cast("long").alias("frame"), codec.text(codec.strip_separator("record", b"\n")).alias("value"))


def refused_copies(spark, sf_dir):
    """What a copy refuses, and that the output stays as it was: absent, or whole."""

    def make(path: str) -> None:
        _groups(path, [b"a\nb\n", b"c\nd\n", b"e\nf\n", b"g\n"])
        _groups(f"{path}.drift", [b"a\nb\n", b"c\n", b"d\ne\n", b"f\n"])
        _groups(f"{path}.there", [b"kept\n"])

    path = _once(spark, sf_dir, "small.txt.seek.zst", make)
    cases = {"off a frame's start": dict(start=1), "past the end": dict(start=8), "off a frame's end": dict(start=0, count=3), "nothing": dict(start=0, count=0), "short last frame": dict(start=2), "too many": dict(start=0, count=99)}
    out = [(name, _outcome(lambda k=k: edit.copy_range(path, f"{path}.new", **k)), exists(f"{path}.new")) for name, k in cases.items()]
    out.append(("uneven", _outcome(lambda: edit.copy_range(f"{path}.drift", f"{path}.new", 0, 2, check_every_frame=False)), exists(f"{path}.new")))
    if exists(f"{path}.new"):
        os.unlink(local(f"{path}.new"))
    out.append(("uneven, every frame", _outcome(lambda: edit.copy_range(f"{path}.drift", f"{path}.new", 0, 4, check_every_frame=True)), exists(f"{path}.new")))
    out.append(("onto itself", _outcome(lambda: edit.copy_range(path, path, 0, 2)), RecordFile(path).total == 7))
    out.append(("onto another", _outcome(lambda: edit.copy_range(path, f"{path}.there", 0, 2, force=False)), RecordFile(f"{path}.there").total == 1))
    return spark.createDataFrame(out, "case string, outcome string, there boolean")


def refused_opens(spark, sf_dir):
    """Files that can't be opened, and how each is refused."""

    def make(path: str) -> None:
        replace(path, lambda out: out.write(b"plain text, much longer than a footer\n" * 3))
        replace(f"{path}.none", lambda out: out.write(seek_table(FrameTable(np.zeros(0, np.uint32), np.zeros(0, np.uint32)))))
        _groups(f"{path}.other", [b"no line ends here"])
        _groups(f"{path}.fine", [b"a\nb\n"])

    path = _once(spark, sf_dir, "refused.seek.zst", make)
    fine = lambda: Handle(spark, f"{path}.fine")
    cases = {"no table": lambda: Handle(spark, path), "no frames": lambda: Handle(spark, f"{path}.none"), "no record": lambda: Handle(spark, f"{path}.other"), "absent": lambda: Handle(spark, f"{path}.absent"), "past the end": lambda: fine().records(3), "no such frame": lambda: fine().from_frame(1), "no such shard": lambda: fine().shard(2, 2), "empty separator": lambda: Separated(b""), "both kinds": lambda: open_path(spark, [f"{path}", "/x/plain.txt"]), "fine": fine}
    return spark.createDataFrame([(name, _outcome(run)) for name, run in cases.items()], "case string, outcome string")


# ---------------------------------------------------------------- more values


def csv_records(spark, sf_dir):
    """Rows to CSV records and back."""

    def make(path: str) -> None:
        rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("record_index"), F.col("event_id").alias("seq"), F.concat(F.lit('a "b", '), "event_type").alias("kind"))
        write_file(codec.encode(rows, "csv", keep=("record_index",)), path)

    return Handle(spark, _once(spark, sf_dir, "seq.csv.seek.zst", make)).values(schema="seq long, kind string").select("record_index", "value.seq", "value.kind")


def xml_records(spark, sf_dir):
    def make(path: str) -> None:
        record = F.concat(F.lit("<e><id>"), F.col("event_id").cast("string"), F.lit("</id><kind>"), "event_type", F.lit("</kind></e>\n")).cast("binary")
        write_file(_table(spark, sf_dir, "events").select(F.col("event_id").alias("record_index"), record.alias("record")), path)

    return Handle(spark, _once(spark, sf_dir, "seq.xml.seek.zst", make)).values(schema="id long, kind string").select("record_index", "value.id", "value.kind")


def logfmt_records(spark, sf_dir):
    def make(path: str) -> None:
        record = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(" kind="), "event_type", F.lit("\n")).cast("binary")
        write_file(_table(spark, sf_dir, "events").select(F.col("event_id").alias("record_index"), record.alias("record")), path)

    return Handle(spark, _once(spark, sf_dir, "seq.logfmt.seek.zst", make)).values().select("record_index", F.col("value")["id"].cast("long").alias("id"), F.col("value")["kind"].alias("kind"))


def invalid_text(spark, sf_dir):
    """Records that aren't UTF-8 have no text; their bytes stay. Record by record."""

    def make(path: str) -> None:
        _groups(path, [b"plain\n\xff\xfe\n", "é\n".encode() + b"\xc3\n"])

    rows = Handle(spark, _once(spark, sf_dir, "invalid.txt.seek.zst", make), format="raw").values()
    return rows.select("record_index", "value", F.hex("record").alias("bytes"))


def raw_encoding(spark, sf_dir):
    """Strings and binaries are records as they are, each ended by one separator; other types need a format."""
    rows = spark.createDataFrame([(0, "a", b"\x01"), (1, "b\n", b"\x02\n"), (2, "", b""), (3, None, None)], "record_index long, s string, b binary")
    text, raw = (codec.encode(rows.select("record_index", c), keep=("record_index",)).withColumnRenamed("record", c) for c in "sb")
    try:
        codec.encode(rows.select("record_index", F.lit(1).alias("n")), keep=("record_index",))
        raise AssertionError("a number became a record")
    except RecordError:
        return text.join(raw, "record_index").select("record_index", F.hex("s").alias("s"), F.hex("b").alias("b"))


def raw_json_file(spark, sf_dir):
    """A JSON file opened as text, all values at once, by a path that says json."""
    rows = open_path(spark, _props(spark, sf_dir).paths, raw=True, partial=False)
    return rows.select("record_index", F.get_json_object("value", "$.k").cast("long").alias("k"))


def handle_identity(spark, sf_dir):
    """Handles are equal by files in order and boundary; the format doesn't matter."""
    a, b = events(spark, sf_dir).paths[0], orders(spark, sf_dir).paths[0]
    h = Handle(spark, [a, b])
    cases = {"same": Handle(spark, [a, b]), "other format": Handle(spark, [a, b], format="raw"), "other order": Handle(spark, [b, a]), "one file": Handle(spark, [a]), "other boundary": Handle(spark, [a, b], Separated(b"|"))}
    return spark.createDataFrame([(name, x == h, len({x, h}) == 1) for name, x in cases.items()], "case string, equal boolean, one_key boolean")


def opened_by_suffix(spark, sf_dir):
    """Paths that end as record files are handles, others Spark's own tables; flags of the one kind are refused for the other."""
    plain, held = _plain(spark, sf_dir), events(spark, sf_dir).paths[0]
    out = [("record file", type(open_path(spark, held)).__name__), ("text", type(open_path(spark, plain)).__name__), ("flag", _outcome(lambda: open_path(spark, plain, raw=True))), ("boundary", _outcome(lambda: open_path(spark, plain, NEWLINE))), ("mixed", _outcome(lambda: open_path(spark, [plain, held])))]
    return spark.createDataFrame(out, "path string, opened string")


def save_refusals(spark, sf_dir):
    """What saving refuses: an existing file without force, an append to none, both at once, trust without a count."""
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def make(path: str) -> None:
        save(rows, path, "n_nationkey", records_per_frame=4)

    path = _once(spark, sf_dir, "saved.jsonl.seek.zst", make)
    cases = {"there": (path, {}), "forced": (path, {"force": True}), "append to none": (f"{path}.no.seek.zst", {"append": True}), "append and force": (path, {"append": True, "force": True}), "trust without append": (path, {"trust_records_per_frame": True, "records_per_frame": 4}), "trust without a count": (path, {"append": True, "trust_records_per_frame": True}), "no such count": (path, {"force": True, "records_per_frame": -1}), "separator without append": (path, {"force": True, "insert_separator": True})}
    return spark.createDataFrame([(name, _outcome(lambda p=p, k=k: save(rows, p, "n_nationkey", **k))) for name, (p, k) in cases.items()], "case string, outcome string")


# ---------------------------------------------------------------- a boundary of one's own


def custom_boundary(spark, sf_dir):
    """Paragraphs: a caller's function ends a record at a blank line, and what follows the last one at the end of its document."""

    def paragraph(data: bytes) -> int | None:
        blank, end = data.find(b"\n\n"), data.find(b"\x00")
        if blank >= 0 and (end < 0 or blank < end):
            return blank + 2
        return end + 1 if end >= 0 else None

    boundary = Custom(paragraph)

    def make(path: str) -> None:
        body = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.lit(b"\x00"))
        runs = _table(spark, sf_dir, "documents").select("doc_id", body.alias("record"))
        write_file(cut_runs(runs, boundary, "doc_id"), path, "doc_id", "at", boundary=boundary, records_per_frame=100)

    h = Handle(spark, _once(spark, sf_dir, "paragraphs.txt.seek.zst", make), boundary)
    return h.scan().select("record_index", F.octet_length("record").cast("long").alias("bytes"), F.md5("record").alias("record_md5"))


REC = "WITH rec AS (SELECT event_id AS record_index, concat_ws('|', event_id, user_id, event_type) AS value FROM events), ord AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, concat_ws('|', o_orderkey, o_custkey, o_orderstatus) AS value FROM orders)"
ALL = f"{REC} SELECT record_index, value FROM rec"
_FRAMES = "SELECT record_index // {n} AS frame, count(*) AS cnt, CAST(sum(strlen(value) + {s}) AS BIGINT) AS decomp_size FROM rec GROUP BY 1"
_N = "SELECT coalesce(1 + min(record_index) FILTER (WHERE e >= 16384), count(*)) AS n FROM (SELECT record_index, sum(strlen(value) + 1) OVER (ORDER BY record_index) AS e FROM rec)"
_AUTO = f"{REC}, n AS ({_N}) SELECT record_index // n AS frame, count(*) AS cnt, CAST(sum(strlen(value) + 1) AS BIGINT) AS decomp_size FROM rec, n GROUP BY 1"
_LAYOUT = REC + ", f AS (" + _FRAMES + ") SELECT frame, cnt, CAST(sum(decomp_size) OVER (ORDER BY frame) - decomp_size AS BIGINT) AS decomp_start, CAST(sum(decomp_size) OVER (ORDER BY frame) AS BIGINT) AS decomp_end, decomp_size FROM f"
_APPENDED = f"{REC}, t AS (SELECT count(*) AS t FROM rec), a AS (SELECT record_index, value FROM rec UNION ALL SELECT t + i, value FROM ord, t WHERE i < 100)"
_DRIFT = "WITH g AS (SELECT * FROM (VALUES (0, 0, 10), (1, 10, 14), (2, 14, 24), (3, 24, 34)) AS v(frame, a, b)), l AS (SELECT frame, a, unnest(range(a, b)) AS i FROM g)"
_BOTH = REC + ", u AS (SELECT record_index AS i, record_index // 64 AS frame FROM rec UNION ALL SELECT (SELECT count(*) FROM rec) + i, (SELECT max(record_index) // 64 + 1 FROM rec) + i // 100 FROM ord)"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "scan_all": (scan_all, ALL),
    "scan_from": (range_of(500, None), f"{ALL} WHERE record_index >= 500"),
    "scan_pushed_range": (scan_pushed, f"{ALL} WHERE record_index >= 130 AND record_index < 333"),
    "lookup_point": (range_of(321, 1), f"{ALL} WHERE record_index = 321"),
    "lookup_points": (points, f"{ALL} WHERE record_index IN (0, 63, 64, 321) OR record_index = (SELECT max(record_index) FROM rec)"),
    "lookup_missing": (lookup_missing, f"{ALL} WHERE record_index = 1000000000"),
    "range_one_frame": (range_of(70, 10), f"{ALL} WHERE record_index BETWEEN 70 AND 79"),
    "range_cross_frames": (range_of(60, 200), f"{ALL} WHERE record_index BETWEEN 60 AND 259"),
    "range_past_end_clipped": (range_past_end_clipped, f"{ALL} WHERE record_index >= (SELECT max(record_index) - 9 FROM rec)"),
    "head_n": (range_of(0, 25), f"{ALL} WHERE record_index < 25"),
    "tail_n": (tail_n, f"{ALL} WHERE record_index > (SELECT max(record_index) - 25 FROM rec)"),
    "skip_take": (skip_take, f"{ALL} WHERE record_index >= 40 AND record_index < 65"),
    "reverse_tail": (reverse_tail, f"{REC} SELECT record_index, value, (SELECT max(record_index) FROM rec) - record_index AS rev FROM rec WHERE record_index > (SELECT max(record_index) - 50 FROM rec)"),
    "filter_contains": (filter_contains, f"{ALL} WHERE contains(value, 'purchase')"),
    "filter_map_take": (filter_map_take, f"{REC} SELECT record_index, split_part(value, '|', 3) AS event_type FROM rec WHERE contains(value, 'purchase') ORDER BY record_index LIMIT 10"),
    "fold_bytes": (fold_bytes, f"{REC} SELECT CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes, CAST(max(strlen(value) + 1) AS BIGINT) AS longest FROM rec"),
    "fold_ordered": (fold_ordered, f"{REC} SELECT list_reduce(list_prepend(CAST(7 AS BIGINT), (SELECT list(CAST(strlen(value) + 1 AS BIGINT) ORDER BY record_index) FROM rec WHERE record_index < 300)), lambda a, x: (a * 31 + x) % 1000003) AS digest"),
    "total_records": (total_records, f"{REC} SELECT count(*) AS records FROM rec"),
    "shard_scan": (shard_scan, f"{REC}, f AS (SELECT max(record_index) // 64 + 1 AS f FROM rec), s AS (SELECT k AS shard, f * k // 4 * 64 AS a, CASE WHEN k = 3 THEN 1000000000000 ELSE f * (k + 1) // 4 * 64 END AS b FROM f, range(4) AS r(k)) SELECT shard, count(record_index) AS n, min(record_index) AS first, max(record_index) AS last FROM s LEFT JOIN rec ON record_index >= a AND record_index < b GROUP BY shard"),
    "from_frame": (from_frame, f"{REC} SELECT record_index - 576 AS record_index, value FROM rec WHERE record_index >= 576"),
    "where_length_select": (where_length_select, f"{REC} SELECT count(*) AS n FROM rec WHERE split_part(value, '|', 3) = 'click'"),
    "uniq_counts": (uniq_counts, f"{REC} SELECT split_part(value, '|', 3) AS event_type, count(*) AS n FROM rec GROUP BY 1"),
    "text_source_agrees": (text_source_agrees, f"{REC} SELECT value FROM rec"),
    "positional_join": (positional_join, f"{REC} SELECT record_index, rec.value, ord.value AS order_value FROM rec JOIN ord ON record_index = i"),
    "frame_table": (frame_layout(b"\n"), _LAYOUT.format(n=N, s=1)),
    "frame_table_sep_multibyte": (frame_layout(b"-=-"), _LAYOUT.format(n=N, s=3)),
    "frame_table_fast": (frame_layout_fast, f"{REC} SELECT record_index // 64 AS frame, count(*) AS cnt FROM rec GROUP BY 1"),
    "auto_n": (auto_n, f"{REC} {_N}"),
    "frames_auto_n": (frames_auto_n, _AUTO),
    "frames_logical": (frames_logical, _AUTO),
    "size_mode_frames": (
        size_mode_frames,
        "WITH RECURSIVE e AS (SELECT event_id AS i, sum(strlen(concat_ws('|', event_id, user_id, event_type)) + 1) OVER (ORDER BY event_id) AS e FROM events), "
        "c AS (SELECT CAST(0 AS BIGINT) AS frame, CAST(0 AS HUGEINT) AS a, (SELECT coalesce(min(e), (SELECT max(e) FROM e)) FROM e WHERE e >= 4000) AS b "
        "UNION ALL SELECT frame + 1, b, (SELECT coalesce(min(e.e), (SELECT max(e) FROM e)) FROM e WHERE e.e >= c.b + 4000) FROM c WHERE b < (SELECT max(e) FROM e)) "
        "SELECT frame, (SELECT count(*) FROM e WHERE e.e > a AND e.e <= b) AS cnt, CAST(b - a AS BIGINT) AS decomp_size FROM c",
    ),
    "verify_uniform_ok": (verify_uniform, f"{REC} SELECT record_index // 64 AS frame, count(*) AS cnt FROM rec GROUP BY 1 HAVING count(*) > 64"),
    "verify_drift": (verify_drift, f"{_DRIFT} SELECT CAST(frame AS BIGINT) AS frame, count(*) AS cnt FROM l WHERE frame < 3 GROUP BY 1 HAVING count(*) <> 10"),
    "drift_misplaced_index": (drift_misplaced_index, "WITH g AS (SELECT * FROM (VALUES (0, 0, 10), (1, 10, 14), (2, 14, 24), (3, 24, 34)) AS v(frame, a, b)) SELECT i AS record_index, CASE WHEN i % 10 < b - a THEN 'line ' || (a + i % 10) END AS value FROM range(40) AS r(i) JOIN g ON i // 10 = frame"),
    "drift_exact_scan": (drift_exact_scan, "SELECT i AS record_index, 'line ' || i AS value FROM range(8, 28) AS r(i)"),
    "handle_summary": (handle_summary, "SELECT CAST(1 AS BIGINT) AS file, 'sep' AS finder, (count(*) + 63) // 64 AS frames, CAST(64 AS BIGINT) AS records_per_frame, count(*) AS records FROM events UNION ALL SELECT 2, 'sep', (count(*) + 99) // 100, 100, count(*) FROM orders"),
    "multi_file_scan": (multi_file_scan, f"{REC}, t AS (SELECT count(*) AS t FROM rec) SELECT CAST(0 AS BIGINT) AS file, record_index, value FROM rec UNION ALL SELECT 1, t + i, value FROM ord, t"),
    "multi_file_range": (multi_file_range, f"{REC}, t AS (SELECT count(*) AS t FROM rec), u AS (SELECT record_index, value FROM rec UNION ALL SELECT t + i, value FROM ord, t) SELECT u.record_index, u.value FROM u, t WHERE u.record_index >= t - 5 AND u.record_index < t + 10"),
    "folder_scan": (folder_scan, ALL),
    "conversations_handle": (conversations_handle, "SELECT row_number() OVER (ORDER BY role, conv_id, turn) - 1 AS record_index, concat_ws('|', role, conv_id, turn) AS value FROM conversations WHERE role IS NOT NULL"),
    "truncate_k": (truncate_k, f"{ALL} WHERE record_index < 448"),
    "truncate_logical": (truncate_logical, f"{ALL} WHERE record_index < 448"),
    "append_records": (append_records, f"{_APPENDED} SELECT record_index, value FROM a, t WHERE record_index >= t + 100 - 130"),
    "append_frame_counts": (append_frame_counts, f"{_APPENDED} SELECT record_index // 64 AS frame, count(*) AS cnt, CAST(sum(strlen(value) + 1) AS BIGINT) AS decomp_size FROM a GROUP BY 1"),
    "append_changed_frames": (append_changed_frames, f"{_APPENDED} SELECT DISTINCT record_index // 64 AS frame FROM a, t WHERE record_index // 64 >= t // 64"),
    "append_frames_join": (append_frames_join, f"{REC} SELECT record_index - 128 AS record_index, value FROM rec WHERE record_index BETWEEN 128 AND 319 UNION ALL SELECT record_index - 640 + 192, value FROM rec WHERE record_index BETWEEN 640 AND 767"),
    "copy_range": (copy_range, f"{REC} SELECT record_index - 192 AS record_index, value FROM rec WHERE record_index BETWEEN 192 AND 575"),
    "copy_range_logical": (copy_range_logical, f"{REC} SELECT record_index - 192 AS record_index, value FROM rec WHERE record_index BETWEEN 192 AND 575"),
    "split_rejoin": (split_rejoin, ALL),
    "split_update_rejoin": (split_update_rejoin, f"{REC} SELECT record_index, CASE WHEN record_index BETWEEN 256 AND 383 THEN 'new ' ELSE '' END || value AS value FROM rec"),
    "insert_separator": (insert_separator, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'a'), (1, 'b'), (2, 'c'), (3, 'd'), (4, 'e'), (5, 'part'), (6, 'f')) AS v(record_index, value)"),
    "json_decode": (json_decode, "SELECT event_id AS record_index, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_variant": (json_variant, "SELECT event_id AS record_index, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_encode_lines": (json_encode_lines, """SELECT event_id AS record_index, '{"seq":' || event_id || ',"kind":"' || event_type || '","inner":{"user":' || user_id || '}}' AS value FROM events"""),
    "json_deep_path": (json_deep_path, "SELECT event_id AS record_index, user_id AS user FROM events"),
    "strip_and_terminate": (strip_and_terminate, "SELECT v AS value, CASE WHEN v LIKE '%' || chr(10) THEN left(v, length(v) - 1) ELSE v END AS stripped, CASE WHEN v = '' OR v LIKE '%' || chr(10) THEN v ELSE v || chr(10) END AS terminated FROM (VALUES ('a' || chr(10)), ('a'), (''), (chr(10)), ('a' || chr(10) || chr(10))) AS t(v)"),
    "fixed_records": (fixed_records, "SELECT vec_id AS record_index, embedding[1] AS first, embedding[64] AS last FROM embeddings"),
    "le32_records": (le32_records, "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS record_index, CAST(strlen(text) + 4 AS BIGINT) AS bytes, md5(text) AS body_md5 FROM documents"),
    "wrong_boundary_disagrees": (
        wrong_boundary_disagrees,
        """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, encode(text) AS b, octet_length(encode(text)) AS n FROM documents)
        SELECT count(*) AS right, CAST(sum(length(decode_lines) + CASE WHEN n % 256 = 10 THEN 1 ELSE 0 END + CASE WHEN n // 256 % 256 = 10 THEN 1 ELSE 0 END + CASE WHEN n // 65536 % 256 = 10 THEN 1 ELSE 0 END) AS BIGINT) AS wrong
        FROM (SELECT n, regexp_replace(CAST(decode(b) AS VARCHAR), '[^\\n]', '', 'g') AS decode_lines FROM d)""",
    ),
    "msgpack_records": (msgpack_records, "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS record_index, conv_id, CAST(strlen(text) + 15 AS BIGINT) AS bytes FROM conversations WHERE text IS NOT NULL"),
    "overlap_separator": (overlap_separator, "SELECT k, k // 2 AS records, k > 0 AND k % 2 = 0 AS whole FROM range(7) AS r(k)"),
    "documents_sep_multi": (documents_sep_multi, "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS record_index, md5(text) AS text_md5 FROM documents"),
    "binary_file_records": (binary_file_records, ALL),
    "count_in_buffers": (count_in_buffers, "SELECT doc_id, CAST(strlen(text) - strlen(replace(text, chr(10), '')) AS BIGINT) AS ended, CAST((strlen(text) - strlen(replace(text, chr(10) || chr(10), ''))) // 2 AS BIGINT) AS blank FROM documents"),
    "save_and_append": (save_and_append, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS record_index, n_nationkey, n_name FROM nation"),
    "stream_scan": (stream_scan, ALL),
    "stream_to_folder": (stream_to_folder, ALL),
    "frame_cutter": (frame_cutter, "SELECT k // 3 AS frame, count(*) AS records, CAST(sum(2) AS BIGINT) AS bytes FROM range(10) AS r(k) GROUP BY 1"),
    "byte_stream": (byte_stream, f"{REC} SELECT CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes, md5(string_agg(value, chr(10) ORDER BY record_index) || chr(10)) AS md5 FROM rec"),
    "range_streamed": (range_streamed, f"{ALL} WHERE record_index BETWEEN 100 AND 599"),
    "glob_scan": (glob_scan, ALL),
    "many_files": (many_files, "WITH r AS (SELECT row_number() OVER (ORDER BY i, k) - 1 AS record_index, i || ' ' || k AS value FROM range(300) AS a(i), range(3) AS b(k) WHERE k < 1 + i % 3) SELECT record_index, value FROM r WHERE record_index BETWEEN 7 AND 206"),
    "compress_file": (compress_file, _AUTO),
    "compress_long_records": (compress_long_records, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(5 AS BIGINT), CAST(40 AS BIGINT)), (1, 5, 5033), (2, 5, 40)) AS v(frame, cnt, decomp_size)"),
    "shard_multi_file": (shard_multi_file, _BOTH + ", s AS (SELECT k AS shard, f * k // 4 AS a, f * (k + 1) // 4 AS b FROM (SELECT max(frame) + 1 AS f FROM u), range(4) AS r(k)) SELECT shard, count(i) AS n, min(i) AS first, max(i) AS last FROM s LEFT JOIN u ON frame >= a AND frame < b GROUP BY shard"),
    "from_frame_multi_file": (from_frame_multi_file, f"{REC} SELECT i - 200 AS record_index, value FROM ord WHERE i >= 200"),
    "exact_past_end": (exact_past_end, "SELECT * FROM (VALUES (CAST(33 AS BIGINT), CAST(1 AS BIGINT)), (34, 0), (35, -1), (100, -1)) AS v(start, records)"),
    "exact_total": (exact_total, "SELECT CAST(34 AS BIGINT) AS records"),
    "reverse_scan": (reverse_scan, f"{REC}, t AS (SELECT max(record_index) AS t FROM rec) SELECT record_index, t - record_index AS rev, value FROM rec, t WHERE t - record_index < 300"),
    "verified_scan": (verified_scan, ALL),
    "verified_lookups": (verified_lookups, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'line 0', false), (9, 'line 9', false), (11, 'line 11', false), (13, 'line 13', false), (14, NULL, true), (19, NULL, true), (20, 'line 14', false)) AS v(record_index, value, refused)"),
    "count_frames_range": (count_frames_range, f"{REC} SELECT record_index // 64 AS frame, count(*) AS cnt FROM rec WHERE record_index // 64 BETWEEN 3 AND 8 GROUP BY 1"),
    "frame_rows": (frame_rows, _LAYOUT.format(n=N, s=1).replace("SELECT frame, cnt, CAST", "SELECT frame AS index, cnt AS records, CAST")),
    "frame_checksums": (frame_checksums, "SELECT 'without' AS file, k AS frame, false AS checksum FROM range(4) AS r(k) UNION ALL SELECT 'with', k, true FROM range(4) AS r(k)"),
    "corrupt_frame": (corrupt_frame, f"{REC} SELECT record_index, CASE WHEN record_index <> 64 THEN value END AS value, record_index = 64 AS refused FROM rec WHERE record_index IN (0, 64, 128)"),
    "cli_compress_cat": (cli_compress_cat, f"{ALL} WHERE record_index BETWEEN 60 AND 159"),
    "cli_compress_pipe": (cli_compress_pipe, ALL),
    "cli_inspect": (cli_inspect, _LAYOUT.format(n=N, s=1).replace("CAST(sum(decomp_size) OVER (ORDER BY frame) AS BIGINT) AS decomp_end, ", "")),
    "cli_edits": (cli_edits, f"{REC} SELECT record_index, value FROM rec WHERE record_index < 256 UNION ALL SELECT record_index - 576 + 256, value FROM rec WHERE record_index BETWEEN 576 AND 703 UNION ALL SELECT 384, 'one' UNION ALL SELECT 385, 'two'"),
    "cli_flags": (cli_flags, "SELECT * FROM (VALUES (NULL, NULL, NULL, 'sep', '0a'), (chr(9), NULL, NULL, 'sep', '09'), (NULL, 'sep', 'ab', 'sep', '6162'), (NULL, 'fixed', '12', 'fixed', '12'), (NULL, 'fixed', '0', 'refused', NULL), (NULL, 'fixed', NULL, 'refused', NULL), (NULL, 'msgpack', NULL, 'msgpack', NULL), (NULL, 'msgpack', '1', 'refused', NULL), (NULL, 'flatbuffers', NULL, 'flatbuffers', NULL), (NULL, 'nothing', NULL, 'refused', NULL), ('a', 'fixed', NULL, 'refused', NULL), (NULL, NULL, 'x', 'refused', NULL), ('', NULL, NULL, 'refused', NULL)) AS v(separator, finder, arg, name, parameter)"),
    "locked_writer": (locked_writer, "SELECT * FROM (VALUES ('held', 'Locked', true), ('off a frame''s start', 'Refused', true), ('free', 'done', true), ('cut', 'done', true)) AS v(writer, outcome, as_expected)"),
    "append_fixed": (append_fixed, "SELECT i AS record_index, i AS value, i // 100 AS frame FROM range(1000) AS r(i)"),
    "append_many": (append_many, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(64 AS BIGINT), CAST(10 AS BIGINT), CAST(4 AS BIGINT)), (1, 64, 6, 5), (2, 64, 11, 5), (3, 64, 14, 5)) AS v(step, per_frame, last_frame, frames)"),
    "append_stream": (append_stream, f"{REC}, t AS (SELECT count(*) AS t FROM rec) SELECT t + record_index AS record_index, value FROM rec, t WHERE record_index < 150"),
    "trailing_empty_frames": (trailing_empty_frames, "SELECT i AS record_index, i // 2 AS frame, chr(CAST(97 + i AS INTEGER)) AS value FROM range(9) AS r(i)"),
    "refused_copies": (refused_copies, "SELECT * FROM (VALUES ('off a frame''s start', 'Refused', false), ('past the end', 'Refused', false), ('off a frame''s end', 'Refused', false), ('nothing', 'Refused', false), ('short last frame', 'Refused', false), ('too many', 'Refused', false), ('uneven', 'done', true), ('uneven, every frame', 'Refused', false), ('onto itself', 'Refused', true), ('onto another', 'Refused', true)) AS v(\"case\", outcome, there)"),
    "refused_opens": (refused_opens, "SELECT * FROM (VALUES ('no table', 'NotSeekable'), ('no frames', 'NoFrames'), ('no record', 'NoRecords'), ('absent', 'RecordError'), ('past the end', 'PastEnd'), ('no such frame', 'SpecError'), ('no such shard', 'SpecError'), ('empty separator', 'SpecError'), ('both kinds', 'RecordError'), ('fine', 'done')) AS v(\"case\", outcome)"),
    "csv_records": (csv_records, "SELECT event_id AS record_index, event_id AS seq, 'a \"b\", ' || event_type AS kind FROM events"),
    "xml_records": (xml_records, "SELECT event_id AS record_index, event_id AS id, event_type AS kind FROM events"),
    "logfmt_records": (logfmt_records, "SELECT event_id AS record_index, event_id AS id, event_type AS kind FROM events"),
    "invalid_text": (invalid_text, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'plain', '706C61696E0A'), (1, NULL, 'FFFE0A'), (2, chr(233), 'C3A90A'), (3, NULL, 'C30A')) AS v(record_index, value, bytes)"),
    "raw_encoding": (raw_encoding, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), '610A', '010A'), (1, '620A', '020A'), (2, '', ''), (3, NULL, NULL)) AS v(record_index, s, b)"),
    "raw_json_file": (raw_json_file, "SELECT event_id AS record_index, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "handle_identity": (handle_identity, "SELECT * FROM (VALUES ('same', true, true), ('other format', true, true), ('other order', false, false), ('one file', false, false), ('other boundary', false, false)) AS v(\"case\", equal, one_key)"),
    "opened_by_suffix": (opened_by_suffix, "SELECT * FROM (VALUES ('record file', 'Handle'), ('text', 'DataFrame'), ('flag', 'SpecError'), ('boundary', 'SpecError'), ('mixed', 'RecordError')) AS v(path, opened)"),
    "save_refusals": (save_refusals, "SELECT * FROM (VALUES ('there', 'Refused'), ('forced', 'done'), ('append to none', 'Refused'), ('append and force', 'SpecError'), ('trust without append', 'SpecError'), ('trust without a count', 'SpecError'), ('no such count', 'SpecError'), ('separator without append', 'SpecError')) AS v(\"case\", outcome)"),
    "custom_boundary": (
        custom_boundary,
        "WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10) || chr(10)), 1) AS i, len(string_split(coalesce(text, ''), chr(10) || chr(10))) AS n FROM documents) "
        "SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS record_index, CAST(strlen(part) + CASE WHEN i < n THEN 2 ELSE 1 END AS BIGINT) AS bytes, md5(encode(part) || CASE WHEN i < n THEN '\\x0A\\x0A'::BLOB ELSE '\\x00'::BLOB END) AS record_md5 FROM p",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
