"""Token files: flat unsigned ids beside 64-bit document offsets, written by the executors and read by memory map.

A token set is a folder with, for every part p: `part-<p>.bin` (ids, little-endian, of the narrowest width of 2 or 4 bytes
that holds every id of the vocabulary and the end id; reader and writer get it as `width`), `part-<p>.idx` (uint64 offsets in
ids: one more than documents, from 0), `part-<p>.doc` (int64 doc_ids) and `part-<p>.nul` (one byte a document, 1 where doc_id
is null). Parts follow each other in doc_id order, or in that of the documents; a part's base is the sum of the ids of the parts before it.
"""

from __future__ import annotations

import mmap
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recframe.llm.common import flat, release, shared_dir, small_batches, tidy

END_ID = 1
#: Words whose ids a worker remembers; beyond that it starts anew, so memory stays bounded.
REMEMBERED = 300_000
#: Bytes of text that are encoded together (a longer text stands alone), and words that are looked up together.
TOGETHER, WORDS_TOGETHER = 3 << 20, 1 << 20

#: Stands between words that are encoded together; a word that holds it is encoded alone.
MARK = "~"
#: Words that are one piece (letters that normalisation keeps but for their case), with a full stop or comma after them or not.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
#: What the byte-level pre-tokenizer turns bytes into that aren't printable Latin-1, by the public rule: 256 and up, in order.
_BYTE_CHARS = {chr(b): chr(256 + i) for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD]) if b >= 0x7F}

_loaded: dict = {}


class _Words:
    """A loaded tokenizer and the words that this worker has met: their ids lie side by side, those of word i from start[i] to start[i + 1]."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.by_word = _by_word(self.tok)
        if not self.by_word:
            return
        self.mark = self.tok.encode(MARK, add_special_tokens=False).ids[0]
        self.stops = [self.tok.encode(c, add_special_tokens=False).ids[0] for c in ".,"]
        # the same model, for words that need no normalisation: only white space parts them, so all of a call's words go in one string
        self.plain = Tokenizer(self.tok.model)  # shared, not copied
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, size = self.tok.model.end_of_word_suffix, self.tok.get_vocab_size(with_added_tokens=True)
        self.last = np.fromiter(((self.tok.id_to_token(i) or "").endswith(suffix) for i in range(size)), bool, size)  # ids that end a piece
        self._forget()

    def _forget(self) -> None:
        self.words, self.start, self.ids = pa.array([""]), np.zeros(2, np.int64), np.zeros(0, "<u4")

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Where these words are among the remembered ones; new ones are encoded, thousands in one call, and remembered."""
        found = pc.index_in(distinct, value_set=self.words)
        if not found.null_count:
            return found.to_numpy()
        missing = pc.is_null(found).to_numpy(zero_copy_only=False)
        new, before = distinct.filter(pa.array(missing)), len(self.words)
        if before > 1 and before + len(new) > REMEMBERED:
            self._forget()
            return self.places(distinct)
        plain = pc.match_substring_regex(new, PLAIN).to_numpy(zero_copy_only=False)
        new = pa.concat_arrays([new.filter(pa.array(plain)), new.filter(pa.array(~plain))])
        n = int(plain.sum())
        counts, ids = zip(*self._plain(new.slice(0, n)), *self._others(new.slice(n).to_pylist()))
        self.words = pa.concat_arrays([self.words, new])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(counts))])
        self.ids = np.concatenate([self.ids, *ids])
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        at[missing] = before + np.where(plain, np.cumsum(plain) - 1, n + np.cumsum(~plain) - 1)
        return at

    def _plain(self, words: pa.Array):
        """Each is one piece, or two with the stop after it, so the ids that end pieces part the words."""
        for a in range(0, len(words), 4096):
            part = words.slice(a, 4096)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), " ")[0].as_py()
            joined = f"{joined} ".lower().replace(". ", " . ").replace(", ", " , ")
            if not joined.isascii():
                joined = joined.encode().decode("latin-1")
                for raw, shown in _BYTE_CHARS.items():
                    joined = joined.replace(raw, shown)
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            stop = (ids == self.stops[0]) | (ids == self.stops[1])
            ends = np.flatnonzero(self.last[ids] & ~np.append(stop[1:], False)) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer parts a plain word")
            yield np.diff(ends, prepend=0), ids

    def _others(self, words: list[str]):
        """Parted by MARK; one that could be mistaken for more than itself goes alone."""
        own = lambda w: MARK in w or "<|" in w
        alone = [w for w in words if own(w)]
        known = dict(zip(alone, (np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(alone, add_special_tokens=False))))
        rest = [w for w in words if w not in known]
        for a in range(0, len(rest), 2048):
            part = rest[a : a + 2048]
            ids = np.array(self.tok.encode_batch_fast([f" {MARK} ".join([*part, ""])], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark)
            if len(at) != len(part):
                raise ValueError("the tokenizer gives its separator's id within a word")
            known.update(zip(part, np.split(ids, at)))
            for w in part[1:]:
                known[w] = known[w][1:]  # the mark before it
        yield np.array([len(known[w]) for w in words], np.int64), np.concatenate([np.zeros(0, "<u4"), *(known[w] for w in words)])


def _by_word(tok) -> bool:
    """Whether this tokenizer gives the words between ASCII white space their ids one by one, in any case, apart from punctuation, with an id of its own kind at a piece's end."""

    def ids(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    apart = all(ids(f" {a}{space}{b}\n") == ids(a) + ids(b) for space in (" ", "\n", "\t  ", "\x0b", "\x0c", "\r\n") for a, b in (("Ab", "cd."), ("é1", "x,y")))
    ended = bool(getattr(tok.model, "end_of_word_suffix", None))
    return apart and ended and ids("ÉA.") == ids("éa") + ids(".") and all(len(ids(x)) == 1 for x in (MARK, ".", ",")) and [x.id for x in tok.model.tokenize("word")] == ids("word")


def tokenizer(path: str) -> _Words:
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        _loaded[path] = _Words(path)
        release()  # what parsing the file took
    return _loaded[path]


def _folded(texts: pa.Array) -> pa.Array:
    """Texts in lower case where that changes nothing: all letters are Latin-1, which the tokenizer folds alike, and no special token may be meant."""
    data, at = flat(texts)
    wide = np.diff(np.searchsorted(np.flatnonzero(data >= 0xC4), at)) > 0
    as_they_are = pc.or_(pa.array(wide), pc.match_substring(texts, "<|"))
    return pc.if_else(as_they_are, texts, pc.utf8_lower(texts)) if pc.any(as_they_are).as_py() else pc.utf8_lower(texts)


def encode_column(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The uint32 ids of all texts (null: empty), as the tokenizer gives them for each whole text, and the offsets of the texts in them.

    The tokenizer drops white space, and no piece of its pre-tokenizer crosses it; so a text's ids are those of its words
    between white space, which repeat and are encoded once. NFC and lower-casing don't reach across white space either.
    A tokenizer of another kind is noticed when it is loaded, and gets whole texts.
    """
    known, texts = tokenizer(path), pc.fill_null(texts, "").cast(pa.large_string())
    if not known.by_word:
        ids = [np.array(e.ids, "<u4") for e in known.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    split = pc.ascii_split_whitespace(_folded(texts))
    rows, words = split.offsets.to_numpy().astype(np.int64), split.flatten().cast(pa.string())
    rows -= rows[0]
    out, offsets, total = [], np.zeros(len(rows), np.int64), 0
    for a in range(0, len(words), WORDS_TOGETHER):
        part = words.slice(a, WORDS_TOGETHER).dictionary_encode()
        place = known.places(part.dictionary)[part.indices.to_numpy()]
        n = np.diff(known.start)[place].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        first = known.start[place] - ends[:-1]
        out.append(known.ids[np.repeat(first.astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)])
        lo, hi = np.searchsorted(rows, [a, a + len(place)], "right")
        offsets[lo:hi] = total + ends[rows[lo:hi] - a]
        total += int(ends[-1])
    return np.concatenate([np.zeros(0, "<u4"), *out]), offsets


def encode(texts: list[str], path: str) -> list[bytes]:
    """The little-endian uint32 ids of each text; see encode_column."""
    ids, at = encode_column(pa.array(texts, pa.string()), path)
    return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return fs.LocalFileSystem(), os.path.abspath(uri)


def _settle(store: fs.FileSystem, draft: str, path: str) -> None:
    """Give a written draft its name; where another attempt of the task was first, its equal file stays."""
    try:
        store.move(draft, path)
    except OSError:
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(draft)


def _put(store: fs.FileSystem, path: str, chunks) -> None:
    """Write under a name of this attempt, then move: a part is whole or absent, and a repeated attempt writes the same bytes."""
    t = TaskContext.get()
    draft = f"{path}.{t.taskAttemptId() if t else 0}"
    with store.open_output_stream(draft, compression=None) as out:
        for x in chunks:
            out.write(x)
    _settle(store, draft, path)


def id_width(path: str, end_id: int = END_ID) -> int:
    """Bytes of an id: 2 if every id is below 65,536, else 4."""
    return 2 if max(tokenizer(path).tok.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4


def _together(batches):
    """doc_id and text of consecutive batches, until they hold about TOGETHER bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.select(["doc_id", "text"]))
        size += batch.column("text").nbytes
        if size >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _write_parts(batches, uri: str, path: str, end_id: int, width: int):
    store, base = _filesystem(uri)
    store.create_dir(base, recursive=True)
    t = TaskContext.get()
    part = t.partitionId()
    name = f"{base}/part-{part:06d}"
    draft = f"{name}.bin.{t.taskAttemptId()}"
    counts, docs = [], []
    with store.open_output_stream(draft, compression=None) as out:
        for table in _together(batches):
            for column, doc in zip(table.column("text").chunks, table.column("doc_id").chunks):
                ids, at = encode_column(column, path)
                # every document's ids, then the end id
                place = np.ones(len(ids) + len(column), bool)
                place[at[1:] + np.arange(len(column))] = False
                ended = np.full(len(place), end_id, "<u4" if width == 4 else "<u2")
                ended[place] = ids
                out.write(ended)
                counts.append(np.diff(at) + 1)
                docs.append(doc)
    _settle(store, draft, f"{name}.bin")
    doc = pa.chunked_array(docs, pa.int64()) if docs else pa.chunked_array([[]], pa.int64())
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype("<u8")
    _put(store, f"{name}.idx", [offsets.tobytes()])
    _put(store, f"{name}.doc", [pc.fill_null(doc, 0).to_numpy().astype("<i8").tobytes()])
    _put(store, f"{name}.nul", [pc.is_null(doc).to_numpy().astype("u1").tobytes()])
    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(doc)], "n_tokens": [int(offsets[-1])]})


def write_tokens(docs: DataFrame, uri: str, path: str, end_id: int = END_ID, ordered: bool = True) -> list[tuple[int, int, int]]:
    """Encode docs (doc_id, text; others are ignored) into a token set at uri; gives (part, documents, base) for each part.

    ordered: documents are dealt by ranges of doc_id and sorted, nulls first; rows of one doc_id by their text, so reruns agree, and
    a doc_id with many rows is dealt over several parts by the beginnings of their texts. Otherwise documents stay where and as they
    are, a part for each of docs' partitions: no shuffle, and an order that an earlier step made is kept. A null or empty text
    holds the end id alone; a very long one is encoded in whole, its words some millions at a time; repeated rows are written again;
    an empty table gives no parts. Only the counts of each part come to the driver, which sums them to bases.
    """
    rows = docs.select("doc_id", "text")
    if ordered:
        first = F.asc_nulls_first("doc_id")
        rows = rows.repartitionByRange(first, F.asc_nulls_first(F.substring("text", 1, 16))).sortWithinPartitions(first, F.asc_nulls_first("text"))
    width = id_width(path, end_id)
    small_batches(docs.sparkSession)
    parts = sorted(rows.mapInArrow(lambda it: tidy(_write_parts(it, uri, path, end_id, width)), "part int, n_docs long, n_tokens long").collect())
    bases = np.concatenate([[0], np.cumsum([p.n_tokens for p in parts])]) if parts else [0]
    return [(p.part, p.n_docs, int(b)) for p, b in zip(parts, bases)]


def _open(store: fs.FileSystem, path: str):
    """The bytes of a file: mapped where it is local, else read."""
    if isinstance(store, fs.LocalFileSystem) and os.path.getsize(path):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with store.open_input_file(path) as f:
        return f.read()


def _read_parts(batches, uri: str, width: int):
    store, base = _filesystem(uri)
    for batch in batches:
        for part, start in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
            name = f"{base}/part-{part:06d}"
            offsets = np.frombuffer(_open(store, f"{name}.idx"), "<u8").astype(np.int64)
            doc, null = np.frombuffer(_open(store, f"{name}.doc"), "<i8"), np.frombuffer(_open(store, f"{name}.nul"), "u1")
            ids = np.frombuffer(_open(store, f"{name}.bin"), f"<u{width}")
            for a in range(0, len(doc), 4096):
                b = min(a + 4096, len(doc))
                crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4")) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[a:b], mask=null[a:b] == 1), pa.array(start + offsets[a:b]), pa.array(np.diff(offsets[a : b + 1])), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_tokens(spark: SparkSession, uri: str, parts: list[tuple[int, int, int]], width: int) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32: one row a document of a token set."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    full = [(p, b) for p, n, b in parts if n]
    if not full:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(full, "part int, base long").repartition(len(full), "part")
    return listed.mapInArrow(lambda it: tidy(_read_parts(it, uri, width)), schema)


def token_files(docs: DataFrame, path: str, uri: str | None = None, end_id: int = END_ID, ordered: bool = True) -> DataFrame:
    """Write docs to a token set (in the shared folder unless uri names one) and read it back; see write_tokens, read_tokens."""
    uri = uri or shared_dir(docs.sparkSession)
    return read_tokens(docs.sparkSession, uri, write_tokens(docs, uri, path, end_id, ordered), id_width(path, end_id))
