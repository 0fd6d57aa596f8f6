"""A streaming query's batches as record files in a folder: one file a batch, named by its number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from recframe.functions.boundary import Boundary
from recframe.operators.write import write_file
from recframe.sources.container import filesystem


def to_folder(stream: DataFrame, path: str, *order_by: str, boundary: Boundary | None = None, extension: str = "txt", **framing) -> DataStreamWriter:
    """A writer of stream (a record column, and what to order by) that is still to be started.

    A batch that is run again replaces its own file, so each record is there once; empty batches leave no file. Read as a
    folder, the files are one run of indices in the order of the batches.
    """

    def put(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store, name = filesystem(path)
        store.create_dir(name, recursive=True)
        write_file(batch, f"{path}/batch-{number:012d}.{extension}.seek.zst", *order_by, boundary=boundary, force=True, **framing)

    return stream.writeStream.foreachBatch(put)
