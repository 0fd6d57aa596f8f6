"""What a reader knows of a record file before it reads: frames, records a frame, total; and which frames an index range needs."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyarrow import fs

from recframe.errors import IncompleteFinal, NoFrames, NoRecords, NoSeparator, PastEnd, RecordError, SpecError
from recframe.functions.boundary import Boundary, Separated
from recframe.sources.container import FrameTable, decode_frame, filesystem, read_bytes, read_seek_table


@dataclass(frozen=True)
class Span:
    """Frames [first, end) and the indices [low, high) of the records wanted from them."""

    first: int
    end: int
    low: int
    high: int


@dataclass(frozen=True)
class Facts:
    """What one opening of a file found, in a few numbers: enough to place records, and to see whether the file still is the same."""

    size: int  # bytes of the file
    frames: int
    per_frame: int
    decompressed: int
    last_whole: int | None = None  # unknown until a total is asked for
    fragment: bool | None = None


class RecordFile:
    """One file. Opening reads the seek table and decodes frame 0; the last frame is decoded only when a total is asked for.

    With the facts of an earlier opening nothing is read until the table is needed.
    """

    def __init__(self, path: str, boundary: Boundary | None = None, table: FrameTable | None = None, facts: Facts | None = None):
        self.path, self.boundary, self.known = path, boundary or Separated(b"\n"), facts
        if facts is not None:
            self.per_frame = facts.per_frame
            return
        if table is not None:
            self.table = table.without_empty_tail()
        if not len(self.table):
            raise NoFrames(f"no frames in {path}")
        if not self.per_frame:
            ends = f"ends with {self.boundary.separator!r}" if self.boundary.separator else "ends"
            raise NoRecords(f"no record in frame 0 of {path} {ends}")

    @cached_property
    def table(self) -> FrameTable:
        return read_seek_table(self.path).without_empty_tail()

    @property
    def table_is_here(self) -> bool:
        return "table" in self.__dict__

    @property
    def facts(self) -> Facts:
        if self.known is not None and "_tail" not in self.__dict__:
            return self.known
        size, total = (self.known.size, self.known.decompressed) if self.known else (self.table.file_size, int(self.table.decompressed.astype(np.int64).sum()))
        return Facts(size, self.frames, self.per_frame, total, *(self._tail if "_tail" in self.__dict__ else (None, None)))

    def frame_bytes(self, i: int) -> bytes:
        start = int(self.table.compressed[:i].astype(np.int64).sum())
        return decode_frame(read_bytes(self.path, start, int(self.table.compressed[i])), int(self.table.decompressed[i]))

    @property
    def frames(self) -> int:
        return self.known.frames if self.known else len(self.table)

    @cached_property
    def per_frame(self) -> int:
        """Whole records of frame 0, which every full frame holds."""
        return self.boundary.count(self.frame_bytes(0))

    @cached_property
    def _tail(self) -> tuple[int, bool]:
        if self.known is not None and self.known.last_whole is not None:
            return self.known.last_whole, bool(self.known.fragment)
        data = self.frame_bytes(self.frames - 1)
        ends = self.boundary.ends(data)
        return len(ends), (int(ends[-1]) if len(ends) else 0) < len(data)

    @property
    def last_whole(self) -> int:
        """Whole records of the last frame."""
        return self._tail[0]

    @property
    def has_fragment(self) -> bool:
        """Whether bytes follow the last whole record of the file."""
        return self._tail[1]

    @property
    def total(self) -> int:
        """Records of the file, by division; a fragment under a separator is one."""
        if self.has_fragment and not self.boundary.fragment_is_record:
            raise self._cut_off(self.per_frame * (self.frames - 1) + self.last_whole)
        return self.per_frame * (self.frames - 1) + self.last_whole + self.has_fragment

    def _cut_off(self, record: int) -> IncompleteFinal:
        return IncompleteFinal(f"{self.path} ends within record {record}")

    @property
    def aligned(self) -> bool:
        """Whether the last frame is full too, and ends whole."""
        return self.last_whole == self.per_frame and not self.has_fragment

    def frame_size(self, i: int) -> int | None:
        return int(self.table.decompressed[i]) if 0 <= i < self.frames else None

    def span(self, start: int, count: int | None) -> Span:
        """The frames that `count` records from `start` need (None: to the end), or a refusal; only the last frame's bounds need it decoded."""
        n, frames = self.per_frame, self.frames
        if start < 0 or count is not None and count < 0:
            raise SpecError("a start and a count can't be negative")
        if start > n * frames or start == n * frames and not (self.last_whole == n and self.has_fragment):
            raise PastEnd(f"{self.path} has no record {start}: its frames have room for {n * frames}")
        if start >= n * (frames - 1) and start - n * (frames - 1) > self.last_whole:
            raise NoSeparator(f"record {start} would be beyond the {self.last_whole} whole records of frame {frames - 1}, the last of {self.path}")
        stop = None if count is None else start + count
        if stop is None or stop > n * (frames - 1):
            whole = n * (frames - 1) + self.last_whole
            if self.has_fragment and not self.boundary.fragment_is_record and (stop is None or stop > whole):
                raise self._cut_off(whole)
            stop = min(self.total if self.boundary.fragment_is_record else whole, stop if stop is not None else 1 << 62)
        stop = max(stop, start)
        first = min(start // n, frames - 1)
        return Span(first, min(-(-stop // n), frames) if stop > start and stop <= n * frames else frames if stop > start else first, start, stop)


class RecordFiles:
    """An ordered list of files as one run of indices: each has its own records a frame, all have one boundary.

    Files are opened together, so that errors come early; counts are summed only as far as a request needs them.
    """

    def __init__(self, paths: list[str], boundary: Boundary | None = None, facts: list[Facts] | None = None):
        if not paths:
            raise SpecError("no file to open")
        self.boundary = boundary or Separated(b"\n")
        if facts is not None:
            now = _sizes(paths)
            self.files = [RecordFile(p, self.boundary, facts=f if f.size == size else None) for p, f, size in zip(paths, facts, now, strict=True)]
        else:
            with ThreadPoolExecutor(min(32, len(paths))) as pool:
                self.files = list(pool.map(lambda p: RecordFile(p, self.boundary), paths))
        self._offsets = [0]

    @property
    def facts(self) -> list[Facts]:
        return [f.facts for f in self.files]

    @property
    def frames(self) -> int:
        """Frames of all files."""
        return sum(f.frames for f in self.files)

    def frame_start(self, frame: int) -> int:
        """The index of the first record of a frame, when the frames of all files are counted through; of the end for the frame after the last."""
        for i, file in enumerate(self.files):
            if frame < file.frames:
                return self.offset(i) + frame * file.per_frame
            frame -= file.frames
        return self.total

    def offset(self, i: int) -> int:
        """Records before file i."""
        while len(self._offsets) <= i:
            self._offsets.append(self._offsets[-1] + self.files[len(self._offsets) - 1].total)
        return self._offsets[i]

    @property
    def total(self) -> int:
        return self.offset(len(self.files))

    def spans(self, start: int = 0, count: int | None = None) -> list[tuple[int, int, Span]]:
        """(file, records before it, span) for each file that the range touches."""
        if len(self.files) == 1:
            return [(0, 0, self.files[0].span(start, count))]
        stop, out = 1 << 62 if count is None else start + count, []
        for i, file in enumerate(self.files):
            low = self.offset(i)
            if stop <= low:
                break
            whole = start <= low and stop == 1 << 62
            if not whole and start >= self.offset(i + 1):
                continue
            own = max(start - low, 0)
            out.append((i, low, file.span(own, None if stop == 1 << 62 else stop - low - own)))
        if not out and start > self.total:
            raise PastEnd(f"there is no record {start}: the last is {self.total - 1}")
        return out


def _sizes(paths: list[str]) -> list[int | None]:
    """Bytes of the files as they are now."""
    stores: dict[str, tuple] = {}
    for p in paths:
        store, name = filesystem(p)
        stores.setdefault(p.partition("://")[0] if "://" in p else "", (store, [], []))[1].append(name)
        stores[p.partition("://")[0] if "://" in p else ""][2].append(p)
    found = {p: info.size for store, names, own in stores.values() for p, info in zip(own, store.get_file_info(names))}
    return [found[p] for p in paths]


#: The suffix that marks record files in folders and patterns.
SUFFIX = ".seek.zst"


def expand(path: str | list[str]) -> list[str]:
    """The files that a path names: itself, those of a folder, or those that match a pattern; the latter two sorted.

    A pattern that matches record files and others is refused; one that matches nothing stays as it is.
    """
    if isinstance(path, (list, tuple)):
        return [x for p in path for x in expand(p)]
    store, name = filesystem(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    if re.search(r"[*?\[]", name):
        import fnmatch

        base = name[: re.search(r"[*?\[]", name).start()].rpartition("/")[0] or "/"
        found = sorted(i.path for i in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if i.is_file and fnmatch.fnmatch(i.path, name))
        if not found:
            return [path]
        if len({x.endswith(SUFFIX) for x in found}) > 1:
            raise RecordError(f"{path} matches record files and others")
        return [prefix + x for x in found]
    info = store.get_file_info(name)
    if info.type == fs.FileType.Directory:
        found = sorted(i.path for i in store.get_file_info(fs.FileSelector(name)) if i.is_file and i.base_name[:1] not in "._")
        if not found:
            raise SpecError(f"{path} holds no record file")
        return [prefix + x for x in found]
    return [path]


def inner_format(path: str) -> str:
    """json for json, jsonl and ndjson, else the extension before .seek.zst, else raw."""
    name = path.rpartition("/")[2].removesuffix(".zst").removesuffix(".seek")
    extension = name.rpartition(".")[2] if "." in name else ""
    return "json" if extension in ("json", "jsonl", "ndjson") else extension or "raw"
