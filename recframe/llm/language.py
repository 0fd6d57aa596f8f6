"""Language ID by mixture inference: every document is a mixture of languages whose words have n-gram likelihoods."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import pieces, small_batches, tidy

#: Bits of the table of hashed letter trigrams.
BITS = 16
#: Lower-case ASCII letters and every byte above ASCII are letters; the rest parts words and counts as one space.
_LETTER = np.full(256, 32, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the doc_id as text has no remainder by 5; also for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket for each letter with its neighbours (a space at the ends of a word), each word's first one, rows' offsets in the words."""
    m = _LETTER[data]
    inside = m != 32
    n = len(m)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    before, after = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    before[1:] = m[:-1]
    before[first] = 32
    after[:-1] = m[1:]
    after[last] = 32
    code = (before << np.uint32(16)) | (m << np.uint32(8)) | after
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS))[inside]
    start = np.flatnonzero(first)
    return bucket, (np.cumsum(inside) - 1)[start] if len(start) else start, np.searchsorted(start, at)


def _counts(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, data, at in pieces(batch.column("text")):
            bucket, start, rows = _trigrams(data, at)
            ends = np.concatenate([start, [len(bucket)]])[rows]
            mine = langs[first : first + len(at) - 1]
            for lang in set(mine):
                chosen = np.flatnonzero(mine == lang)
                found = np.concatenate([bucket[ends[i] : ends[i + 1]] for i in chosen])
                values, n = np.unique(found, return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(values), "bucket": values.astype(np.int64), "n": n.astype(np.int64)})


def fit(docs: DataFrame, each: int = 2000, most_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability [language, bucket] of each hashed letter trigram.

    Only text and non-null lang of rows that aren't held out count. At most about `each` rows of a language do, chosen by the
    hash of their doc_id, and the `most_languages` values of lang with most rows (equals: those that sort first) are learned: that
    bounds the fit whatever the corpus holds; the model has 2**16 numbers a language, 64 MB at most by default.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, each / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not share:
        return [], np.zeros((0, 1 << BITS), np.float32)
    limit = F.create_map(*chain(*((F.lit(k), F.lit(int(v * 2**31))) for k, v in share.items())))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 31)) < limit[F.col("lang")]).select("lang", "text")
    counts = sample.mapInArrow(lambda it: tidy(_counts(it)), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(share)
    table = np.full((len(langs), 1 << BITS), 0.05)
    number = {x: i for i, x in enumerate(langs)}
    names = counts.column("lang").combine_chunks().dictionary_encode()
    row = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(counts) else np.zeros(0, np.int64)
    table[row, counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _em(p: list[np.ndarray], share: np.ndarray, starts: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares [language, document] after so many rounds, and each document's log likelihood under them (less its words' best)."""
    for left in range(rounds, -1, -1):
        each = [x * np.repeat(s, counts) for x, s in zip(p, share)]
        total = np.add.reduce(each)
        if not left:
            return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), starts)
        np.reciprocal(total, out=total)
        share = np.stack([np.add.reduceat(x * total, starts) for x in each]) / counts
        share = np.maximum(share, 1e-9)
    raise AssertionError


def mixtures(words: np.ndarray, counts: np.ndarray, penalty: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with at least one word: the order of their languages by share, shares of the chosen set (in that order, else 0), confidence.

    words: log likelihood [language, word]. Expectation-maximisation over all languages orders them; then sets of the first 1,
    2, ... languages are refitted, and a document goes on as long as its log likelihood grows by more than
    penalty * log(words) for the language added.
    """
    k, docs = len(words), len(counts)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    alone = np.stack([np.add.reduceat(x, starts) for x in words.astype(np.float64)])
    best = words.max(0)
    p = [np.exp(np.maximum(x - best, -60)) for x in words]
    share, _ = _em(p, np.full((k, docs), 1 / k, np.float32), starts, counts, rounds)
    order = np.argsort(-share, axis=0, kind="stable")
    # a single language is the one that explains the whole document best
    top = alone.argmax(0)
    order = np.concatenate([top[None], np.stack([o[o != t] for o, t in zip(order.T, top)], 1)]) if k > 1 else order
    chosen = np.zeros((k, docs))
    chosen[0] = 1
    like = alone.max(0) - np.add.reduceat(best.astype(np.float64), starts)
    going = np.arange(docs)
    owner = np.repeat(np.arange(docs), counts)
    for size in range(2, k + 1):
        going = going[np.take_along_axis(share, order, 0)[size - 1, going] * counts[going] >= 1]
        if not len(going):
            break
        mask = np.zeros(docs, bool)
        mask[going] = True
        at = np.flatnonzero(mask[owner])
        n, own = counts[going], owner[at]
        part = [np.stack(p)[order[j][own], at] for j in range(size)]
        begin = np.take_along_axis(share, order, 0)[:size, going]
        fitted, new = _em(part, begin / begin.sum(0), np.concatenate([[0], np.cumsum(n)[:-1]]), n, rounds // 2)
        better = new - like[going] > penalty * np.log(n + 1)
        going = going[better]
        chosen[:, going] = 0
        chosen[:size, going] = fitted[:, better]
        like[going] = new[better]
    second = np.sort(alone, 0)[-2] if k > 1 else alone.max(0) - 50
    return order, chosen, 1 / (1 + np.exp(-np.minimum(alone.max(0) - second, 50)))


def _judged(batch: pa.RecordBatch, langs: list[str], table: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lang_pred, score and lang_shares of each row."""
    names = np.array(langs, object)
    out = []
    for first, data, at in pieces(batch.column("text")):
        docs = len(at) - 1
        bucket, start, rows = _trigrams(data, at)
        counts = np.diff(rows)
        some = np.flatnonzero(counts)
        pred, score, share = np.full(docs, "und", object), np.zeros(docs), np.full(docs, "", object)
        if len(some) and langs:
            words = np.stack([np.add.reduceat(x[bucket], start) for x in table])
            order, chosen, sure = mixtures(words, counts[some], penalty)
            lead = chosen.argmax(0)
            each = np.arange(len(some))
            pred[some] = names[order[lead, each]]
            score[some] = np.clip(chosen[lead, each] * sure, 0, 1)
            for i in each:
                share[some[i]] = ",".join(f"{names[order[j, i]]}:{chosen[j, i]:.3f}" for j in np.argsort(-chosen[:, i], kind="stable") if chosen[j, i] > 0)
        text = batch.column("text").slice(first, docs)
        ascii_letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum((_LETTER[data] != 32) & (data < 128), out=ascii_letters[1:])
        for i in some[ascii_letters[at[some + 1]] == ascii_letters[at[some]]]:  # other scripts, or no letters at all
            if not any(c.isalpha() for c in text[i].as_py()):
                pred[i], score[i], share[i] = "und", 0.0, ""
        out.append((pred, score, share))
    return tuple(np.concatenate(x) if out else np.zeros(0, object) for x in (zip(*out) if out else [(), (), ()]))


def _predict(batches, model, penalty: float):
    for batch in batches:
        pred, score, share = _judged(batch, *model.value, penalty)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.string())], ["doc_id", "lang_pred", "score", "lang_shares"])


def _identified(batches, model, penalty: float, least: float):
    for batch in batches:
        pred, score, _ = _judged(batch, *model.value, penalty)
        yield batch.filter(pa.array((pred != "und") & (score.astype(float) >= least), pa.bool_()))


def identify(docs: DataFrame, each: int = 2000, penalty: float = 2.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_shares for every row of docs (doc_id, text, lang; others are ignored).

    The model is fitted on rows of docs (see fit) and predicts from text alone. A text that is null or without a letter is
    `und` with score 0, as is every text if no row has a language. score is the leading language's share in the chosen set
    times its odds against the next single language. Ties go to the language that sorts first; repeated rows get equal rows; a very
    long text counts with all its words (about 30 bytes are held for each of its bytes); an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, each))  # its size is bounded by the fit
    found = docs.select("doc_id", "text").mapInArrow(lambda it: tidy(_predict(it, model, penalty)), "doc_id long, lang_pred string, score double, lang_shares string")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_shares")


def keep_identified(docs: DataFrame, least: float = 0.2, each: int = 2000, penalty: float = 2.0) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known: not `und`, and with a score of at least `least`.

    So rows with a null or empty text, or one without a letter, go; repeated rows stay or go alike; an empty table gives no rows,
    and where no row has a language none stays.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, each))
    return docs.mapInArrow(lambda it: tidy(_identified(it, model, penalty, least)), docs.schema)
