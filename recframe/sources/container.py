"""The container: independent zstd frames and, at the end, a skippable frame with their sizes (public Zstandard Seekable Format)."""

from __future__ import annotations

import os
import re
import struct
import threading
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import zstandard
from pyarrow import fs

from recframe.errors import NotSeekable, RecordError

#: Fixed values of the public format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, ZSTD_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0xFD2FB528
FOOTER, CHECKSUM_FLAG = 9, 0x80
#: A frame's content is at most this long.
MOST_FRAME = 1 << 30


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Where a path or URI lives."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass(frozen=True, eq=False)
class FrameTable:
    """Compressed and decompressed sizes of the frames; offsets are their running sums."""

    compressed: np.ndarray
    decompressed: np.ndarray
    #: Bytes of the file that it was read from.
    file_size: int = 0

    def __len__(self) -> int:
        return len(self.compressed)

    def starts(self, sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])

    def without_empty_tail(self) -> FrameTable:
        """Without the empty frames that some writers leave at the end; an empty file keeps one."""
        full = np.flatnonzero(self.decompressed)
        n = int(full[-1]) + 1 if len(full) else min(1, len(self))
        return FrameTable(self.compressed[:n], self.decompressed[:n], self.file_size)

    def part(self, a: int, b: int) -> FrameTable:
        return FrameTable(self.compressed[a:b], self.decompressed[a:b])


def seek_table(table: FrameTable) -> bytes:
    body = np.stack([table.compressed, table.decompressed], 1).astype("<u4").tobytes()
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body) + FOOTER) + body + struct.pack("<IBI", len(table), 0, SEEKABLE_MAGIC)


def read_seek_table(path: str) -> FrameTable:
    """The table at the end of a file, in two reads whatever the file's size."""
    store, name = filesystem(path)
    try:
        with store.open_input_file(name) as f:
            return table_of(f, f.size(), path)
    except FileNotFoundError:
        raise RecordError(f"{path} doesn't exist") from None


def table_of(f: BinaryIO, size: int, label: str) -> FrameTable:
    """The table at the end of anything that can be read at a place."""
    if size < FOOTER + 8:
        raise NotSeekable(f"{label} is shorter than any seekable file")
    f.seek(size - FOOTER)
    n, flags, magic = struct.unpack("<IBI", f.read(FOOTER))
    if magic != SEEKABLE_MAGIC:
        raise NotSeekable(f"{label} has no seekable table at its end")
    each = 12 if flags & CHECKSUM_FLAG else 8
    start = size - FOOTER - n * each - 8
    if start < 0:
        raise NotSeekable(f"the seek table of {label} is longer than the file")
    f.seek(start)
    raw = f.read(8 + n * each)
    if struct.unpack_from("<II", raw) != (SKIPPABLE_MAGIC, n * each + FOOTER):
        raise NotSeekable(f"the seek table of {label} has a wrong header")
    sizes = np.frombuffer(raw, "<u4", offset=8).reshape(n, each // 4)
    table = FrameTable(sizes[:, 0].copy(), sizes[:, 1].copy(), size)
    if int(table.compressed.astype(np.int64).sum()) != start:
        raise NotSeekable(f"the frames of {label} don't fill the file up to its seek table")
    return table


_local = threading.local()


def _context(kind: type, **options):
    """A thread's own (de)compressor of these options: making one costs more than a small frame."""
    known = _local.__dict__
    key = kind.__name__, *options.values()
    if key not in known:
        known[key] = kind(**options)
    return known[key]


def encode_frame(data: bytes, level: int = 3, checksum: bool = True) -> bytes:
    if len(data) > MOST_FRAME:
        raise RecordError(f"a frame of {len(data)} bytes is above the limit of {MOST_FRAME}")
    return _context(zstandard.ZstdCompressor, level=level, write_checksum=checksum).compress(data)


def decode_frame(raw: bytes, size: int) -> bytes:
    """A frame's content; its checksum is verified if it has one."""
    if not size:
        return b""
    data = _context(zstandard.ZstdDecompressor).decompress(raw, max_output_size=size)
    if len(data) != size:
        raise RecordError(f"a frame holds {len(data)} bytes rather than {size}")
    return data


def read_bytes(path: str, start: int, size: int) -> bytes:
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        return f.read(size)


def has_checksum(path: str, start: int = 0) -> bool:
    """Whether the frame at `start` carries a content checksum."""
    head = read_bytes(path, start, 5)
    return len(head) == 5 and bool(head[4] & 4)
