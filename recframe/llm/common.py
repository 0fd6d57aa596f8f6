"""Shared pieces of the training-data operators: tables, materialisation and vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from recframe.session import shared_dir, written

__all__ = ["shared_dir"]
#: ASCII white space of the contracts: [\x20\x09-\x0D]
WHITE_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The one of the library: a table in the shared folder cuts the lineage in a way that survives lost executors, and has a size that Catalyst knows.
materialise = written


#: Rows that go to Python at once; with Spark's usual 10,000 whole texts a worker and the JVM hold tens of megabytes more.
BATCH_ROWS = 1000


#: Bytes that go to Python at once, but for a longer row.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold at most BATCH_ROWS rows and about BATCH_BYTES from here on; settings below that stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(str(spark.conf.get(name)).rstrip("b")) <= most:
            spark.conf.set(name, most)


def release() -> None:
    """Give back to the system what this process's allocators hold and don't use."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(batches: Iterator) -> Iterator:
    """The same batches; memory is released when the last has passed, as an idle worker needs none of it."""
    try:
        yield from batches
    finally:
        release()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as a column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


# ---------------------------------------------------------------- word hashing

_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            for k, r in enumerate((_R, _R_INVERSE)):
                p = np.full(size, r, np.uint64)
                p[0] = 1
                _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def byte_classes(separators: bytes, fold_case: bool = False) -> np.ndarray:
    """256 hash values by byte, 0 for a separator."""
    t = _BYTE.copy()
    if fold_case:
        t[65:91] = t[97:123]
    t[list(separators)] = 0
    return t


#: Words of near-duplicate operators: runs of ASCII letters and digits and of all characters above ASCII, in lower case.
WORDS = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()), fold_case=True)
#: The same for whole texts, as a regular expression that finds a word's first character.
WORD_START = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals from U+00C0 to U+00DE in lower case."""
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    if len(capital):
        data = data.copy()
        data[capital] += 0x20
    return data


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = 1 << 19):
    """Slices of consecutive rows with about `most` bytes (a longer row stands alone): (first row, bytes, offsets)."""
    data, at = flat(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


#: Bytes that are hashed at once; longer runs are cut between words.
SEGMENT = 1 << 20


def _segments(data: np.ndarray, classes: np.ndarray):
    """Ends of runs of about SEGMENT bytes, none within a word."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + SEGMENT, n)
        while hi < n and classes[data[hi - 1]]:  # after the next separator
            gap = np.flatnonzero(classes[data[hi : hi + SEGMENT]] == 0)
            hi = hi + int(gap[0]) + 1 if len(gap) else min(hi + SEGMENT, n)
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, at: np.ndarray, classes: np.ndarray = WORDS) -> tuple[np.ndarray, ...]:
    """Hash of every word, its first and end byte, and the offsets of the rows in the words. By default texts are first put through lower_latin.

    A word is a maximal run of bytes whose class is not 0; it never crosses rows. A long text is hashed a megabyte at a time, so
    beside its words' numbers (24 bytes a word) what is held doesn't grow with it.
    """
    if len(data) <= SEGMENT:
        h, start, end = _hashed(data, at, classes)
    else:
        parts = [[], [], []]
        for lo, hi in _segments(data, classes):
            own = at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo
            for held, x, add in zip(parts, _hashed(data[lo:hi], own, classes), (0, lo, lo)):
                held.append(x + add if add else x)
        h, start, end = (np.concatenate(x) for x in parts)
    return h, start, end, np.searchsorted(start, at)


def _hashed(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    value = classes[lower_latin(data) if classes is WORDS else data]
    inside = value != 0
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end


def word_hash(word: str, classes: np.ndarray = WORDS) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    h = word_hashes(raw, np.array([0, len(raw)]), classes)[0]
    assert len(h) == 1, word
    return int(h[0])


def shingles(h: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and the offsets of the rows in them.

    A row with 1 to k - 1 words has one shingle of all its words, a row without words none.
    """
    counts = np.diff(rows)
    n = len(h)
    q = np.uint64(0xD6E8FEB86659FD93)
    s = np.zeros(n, np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    inside = rows[1:].repeat(counts) - np.arange(n)  # words from here to the end of the row
    for j in range(k - 1, -1, -1):
        s *= q
        s += np.where(inside > j, padded[j : j + n], 0).astype(np.uint64)
    s = mix(s + np.uint64(k))
    out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(out)])
    at = np.arange(offsets[-1]) - offsets[:-1].repeat(out) + rows[:-1].repeat(out)
    return s[at], offsets
