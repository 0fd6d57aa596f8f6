"""A plain model of record files: lists of records cut into frames."""

import numpy as np

from recframe.functions.boundary import Separated
from recframe.sources.container import FrameTable, encode_frame, seek_table


def put_frames(path, frames, checksum=True):
    """A file with exactly these frames."""
    raw = [encode_frame(f, checksum=checksum) for f in frames]
    table = FrameTable(np.array([len(x) for x in raw], np.uint32), np.array([len(f) for f in frames], np.uint32))
    path.write_bytes(b"".join(raw) + seek_table(table))
    return str(path)


def cut(records, n):
    return [b"".join(records[i : i + n]) for i in range(0, len(records), n)]


def lines(count, fragment=False, first=0):
    out = [f"record {i} {'x' * (i * 7 % 23)}\n".encode() for i in range(first, first + count)]
    return [*out, b"unterminated"] if fragment else out


def walk(data, separator):
    """Records by a plain left-to-right search, and what is left."""
    out, at = [], 0
    while (end := data.find(separator, at)) >= 0:
        out.append(data[at : end + len(separator)])
        at = end + len(separator)
    return out, data[at:]


NEWLINE = Separated(b"\n")
