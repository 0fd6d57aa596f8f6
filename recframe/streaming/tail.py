"""Structured Streaming over record files that grow: the offset is a count of records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader

from recframe.sources.layout import RecordFiles, expand
from recframe.sources.records import FrameRange, _boundary, _true, plan, read_frames


class TailReader(DataSourceStreamReader):
    """Batches of new records of a file, or of a folder to which files are added.

    Appending rewrites a file's last frame, so only full frames count as settled; the records of a last frame that isn't full
    come when it fills, when another file follows, or at once with the option include_tail=true.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options

    def _files(self) -> RecordFiles:
        named = json.loads(self.options["paths"]) if self.options.get("paths") else self.options["path"]
        return RecordFiles(expand(named), _boundary(self.options))

    def initialOffset(self) -> dict:
        return {"records": int(self.options.get("from", 0))}

    def latestOffset(self) -> dict:
        files = self._files()
        last = files.files[-1]
        if _true(self.options.get("include_tail")) or last.aligned:
            return {"records": files.total}
        return {"records": files.offset(len(files.files) - 1) + last.per_frame * (last.frames - 1)}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        if end["records"] <= start["records"]:
            return []
        return plan(self._files(), start["records"], end["records"] - start["records"], self.options, clip=True)

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        yield from read_frames(partition)

    def commit(self, end: dict) -> None:
        pass
