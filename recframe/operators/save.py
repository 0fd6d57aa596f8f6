"""Opening and saving by name: paths that end in .seek.zst are record files, all others are Spark's own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recframe.errors import RecordError, Refused, SpecError
from recframe.functions import codec
from recframe.functions.boundary import Boundary, Separated
from recframe.operators import edit
from recframe.operators.publish import exists
from recframe.operators.read import Handle
from recframe.operators.write import write_file
from recframe.plans.indexing import with_record_index
from recframe.session import register
from recframe.sources.container import decode_frame, table_of
from recframe.sources.layout import SUFFIX, expand, inner_format


def open_path(spark: SparkSession, path: str | list[str], boundary: Boundary | None = None, raw: bool = False, partial: bool = True, schema: str | None = None, **options) -> Handle | DataFrame:
    """A handle for record files; Spark's reader for the extension of others, which take no boundary and no options of handles.

    raw: records are text, whatever the extension says. partial=False gives all values (by schema where the format needs one)
    instead of a handle.
    """
    paths = expand(path)
    kinds = {p.endswith(SUFFIX) for p in paths}
    if len(kinds) > 1:
        raise RecordError(f"{path} names record files and others")
    if kinds == {True}:
        handle = Handle(spark, paths, boundary, **options | ({"format": "raw"} if raw else {}))
        return handle if partial else handle.values(schema=schema)
    if boundary is not None or options or raw or not partial:
        raise SpecError(f"{path} isn't a record file: it takes no boundary and no options of one")
    extension = paths[0].removesuffix(".gz").removesuffix(".zst").rpartition(".")[2]
    reader = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json"}.get(extension, "text")
    return spark.read.format(reader).load(paths)


def save(
    df: DataFrame,
    path: str,
    *order_by: str,
    boundary: Boundary | None = None,
    format: str | None = None,
    column: str | None = None,
    append: bool = False,
    force: bool = False,
    insert_separator: bool = False,
    trust_records_per_frame: bool = False,
    records_per_frame: int | None = None,
    **framing,
) -> None:
    """Values as records of a file: encoded by the format that the path names (or `format`), terminated, written or appended.

    An existing file needs append or force, never both; append needs it to exist.
    """
    boundary = boundary or Separated(b"\n")
    there = exists(path)
    if append and force:
        raise SpecError("append adds to a file and force replaces it: one of them")
    if records_per_frame is not None and records_per_frame <= 0:
        raise SpecError("records_per_frame must be above 0")
    if trust_records_per_frame and not (append and records_per_frame):
        raise SpecError("trusting the records of a frame needs append, and their number")
    if insert_separator and not (append and boundary.separator):
        raise SpecError("inserting a separator needs append, and a boundary that has one")
    if append and not there:
        raise Refused(f"{path} doesn't exist: there is nothing to append to")
    if there and not (append or force):
        raise Refused(f"{path} exists: append to it, or force to replace it")
    format = format or inner_format(path)
    if format not in ("json", "csv"):
        format = "raw"
    keep = tuple(dict.fromkeys(order_by)) or (("record_index",) if "record_index" in df.columns else ())
    if not keep:
        raise SpecError("rows have no order of their own: say what to order by")
    rows = codec.encode(df.withColumns({f"_by_{i}": df[c] for i, c in enumerate(keep)}), format, boundary.separator, column, tuple(f"_by_{i}" for i in range(len(keep)))) if order_by else codec.encode(df, format, boundary.separator, column, keep)
    names = [f"_by_{i}" for i in range(len(keep))] if order_by else list(keep)
    if append:
        edit.append_records(path, with_record_index(rows, *names, name="record_index") if order_by else rows, boundary, insert_separator, framing.get("level", 3), records_per_frame, trust_records_per_frame)
    else:
        write_file(rows, path, *(names if order_by else ()), boundary=boundary, force=force, records_per_frame=records_per_frame, **framing)


def records_of_bytes(df: DataFrame, boundary: Boundary | None = None, start: int = 0, count: int | None = None) -> DataFrame:
    """path, record_index, record from path and content: record files that are already bytes in rows, such as those of binaryFile.

    Every row is read where it is, through its seek table: only the frames that count records from start need are decoded, one
    at a time. A file here must fit a row, that is 2 GiB.
    """
    register(df.sparkSession)
    boundary = boundary or Separated(b"\n")

    def decode(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = raw.as_buffer()
                table = table_of(pa.BufferReader(data), data.size, path).without_empty_tail()
                starts, per_frame = table.starts(table.compressed), 0
                for i in range(len(table)):
                    first = i * per_frame if per_frame else 0
                    if per_frame and (first + per_frame <= start and i < len(table) - 1):
                        continue
                    if count is not None and first >= start + count:
                        break
                    frame = decode_frame(data.slice(int(starts[i]), int(table.compressed[i])).to_pybytes(), int(table.decompressed[i]))
                    ends = boundary.ends(frame)
                    if i == 0:
                        per_frame = len(ends)
                    if boundary.fragment_is_record and i == len(table) - 1 and (int(ends[-1]) if len(ends) else 0) < len(frame):
                        ends = np.append(ends, len(frame))
                    lo, hi = max(start - first, 0), len(ends) if count is None else min(start + count - first, len(ends))
                    if lo < hi:
                        offsets = np.concatenate([[0], ends]).astype(np.int32)[lo : hi + 1]
                        record = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(frame)])
                        yield pa.RecordBatch.from_arrays([pa.array([path] * (hi - lo), pa.string()), pa.array(np.arange(first + lo, first + hi)), record], ["path", "record_index", "record"])

    return df.select("path", "content").mapInArrow(decode, "path string, record_index long, record binary")
