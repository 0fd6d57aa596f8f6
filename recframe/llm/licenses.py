"""License scans: a file's licence words of highest IDF are looked up in a positional index of licence passages, matched by relative position, aligned, and verified by key phrases."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import byte_classes, pieces, small_batches, tidy, word_hashes
from recframe.llm.license_texts import PASSAGES

#: Words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; bytes above ASCII belong to words.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
CLASSES = byte_classes(_SEPARATORS, fold_case=True)

#: Fixed values of the base scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: A template's words may stand so far from their places, as a share of its words; four words at least.
DRIFT = 0.25


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), CLASSES)[0]


@dataclass(frozen=True)
class Template:
    """A passage: its labels, words, mandatory phrases, and how many words what surrounds a word may have more or less than here."""

    labels: tuple[str, ...]
    words: np.ndarray
    phrases: list[np.ndarray]

    @property
    def drift(self) -> int:
        return max(4, int(len(self.words) * DRIFT))


def templates() -> list[Template]:
    return [Template(labels, _hashes(text), [_hashes(p) for p in phrases]) for labels, text, phrases in PASSAGES]


def vocabulary() -> np.ndarray:
    """The sorted hashes of all words of the templates."""
    return np.unique(np.concatenate([t.words for t in templates()]))


def _frequencies(batches, words: np.ndarray):
    """For each licence word, documents of this task that hold it; and all its documents."""
    count, docs = np.zeros(len(words), np.int64), 0
    for batch in batches:
        for _, data, at in pieces(batch.column("text")):
            h, _, _, rows = word_hashes(data, at, CLASSES)
            place = np.minimum(np.searchsorted(words, h), len(words) - 1)
            hit = np.flatnonzero(words[place] == h)
            doc = np.searchsorted(rows, hit, "right") - 1
            pairs = np.unique(doc * len(words) + place[hit])
            count += np.bincount(pairs % len(words), minlength=len(words))
            docs += len(at) - 1
    yield pa.RecordBatch.from_pydict({"word": np.arange(len(words) + 1), "n": np.concatenate([count, [docs]])})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the word)) of each licence word, over all documents.

    Every task sends one count a licence word; what comes to the driver has the size of the templates.
    """
    words = vocabulary()
    small_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(lambda it: tidy(_frequencies(it, words)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(words) + 1)
    for r in counts:
        n[r["word"]] = r["n"]
    return np.log((1 + n[-1]) / (1 + n[:-1]))


class Index:
    """Postings (template, places) of every licence word, and what each word weighs in each template: its IDF, so that a template's words sum to 1."""

    #: A file's words are looked up in a template until they are this share of its weight.
    LOOKED_UP = 0.5

    def __init__(self, idf: np.ndarray, least: float):
        self.words, self.least, self.templates = vocabulary(), least, templates()
        self.weights: list[np.ndarray] = []  # by place in the template
        self.share = np.zeros((len(self.words), len(self.templates)), np.float32)
        self.postings: list[list[tuple[int, np.ndarray]]] = [[] for _ in self.words]
        for t, template in enumerate(self.templates):
            number = np.searchsorted(self.words, template.words)
            weight = idf[number] + 1e-6  # where no word is rarer than another, all weigh alike
            self.weights.append(weight / weight.sum())
            np.add.at(self.share[:, t], number, self.weights[t])
            for w in np.unique(number).tolist():
                self.postings[w].append((t, np.flatnonzero(number == w)))
        self.rank = np.empty(len(self.words), np.int64)  # from the highest IDF down
        self.rank[np.argsort(-idf, kind="stable")] = np.arange(len(self.words))

    def possible(self, owner: np.ndarray, word: np.ndarray, docs: int) -> np.ndarray:
        """[document, template]: whether the document holds words of enough of the template's weight, wherever they stand."""
        held = np.zeros((docs, len(self.words)), np.float32)
        held[owner, word] = 1
        return held @ self.share >= self.least - 1e-4

    def labels(self, h: np.ndarray, at: np.ndarray, word: np.ndarray, possible: np.ndarray) -> tuple[set[str], float]:
        """Labels of one text and its best score. h: its words; at, word: positions of licence words, and which they are.

        The text's licence words are looked up from the highest IDF down, each in its postings for the templates that are
        possible; a template gets no more once those looked up are half of its weight. Each position votes for (template, start
        of the template in the text). A passage that holds `least` of the weight lacks at most the rest, so what it lacks
        of the words looked up is no more: where the postings of starts within the template's drift weigh as much as that
        leaves, template and text are aligned, and the mandatory phrases must stand nearby. So no passage whose agreeing words lie
        within the drift is lost, and none is found whose words lie beyond twice the drift.
        """
        order = np.argsort(self.rank[word], kind="stable")
        cuts = np.flatnonzero(np.diff(word[order], prepend=-1))
        wanted = {int(t): 0.0 for t in np.flatnonzero(possible)}
        votes: dict[int, tuple[list, list]] = {t: ([], []) for t in wanted}
        looked = dict(wanted)
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            if not wanted:
                break
            positions = at[order[lo:hi]]
            for t, places in self.postings[word[order[lo]]]:
                if t in wanted:
                    votes[t][0].append((positions[:, None] - places).ravel())
                    votes[t][1].append(np.tile(places, len(positions)))
                    looked[t] += float(self.weights[t][places].sum())
                    if looked[t] >= self.LOOKED_UP:
                        del wanted[t]
        found, best = set(), 0.0
        for t, (starts, places) in votes.items():
            template = self.templates[t]
            if not starts:
                continue
            need = looked[t] - (1 - self.least) - 1e-6
            passed = -1 << 60  # the last start whose passage gave its labels
            for start in _starts(np.concatenate(starts), np.concatenate(places), self.weights[t], template.drift, need):
                if start <= passed + template.drift:
                    continue
                # all starts within the drift of the first vote's, on either side
                score = self.aligned(t, h, start - template.drift, 2 * template.drift)
                if score >= self.least - 1e-9:
                    near = h[max(0, start - len(template.words)) : start + template.drift + 2 * len(template.words)]
                    if all(_occurs(near, p) for p in template.phrases):
                        found.update(template.labels)
                        best, passed = max(best, min(score, 1.0)), start
        return found, best

    def aligned(self, t: int, h: np.ndarray, start: int, drift: int) -> float:
        """The largest share of the template's weight in words that agree in order, each at one of the starts from `start` to `start + drift`."""
        words, weight = self.templates[t].words, self.weights[t]
        place = start + np.arange(len(words))[:, None] + np.arange(drift + 1)
        inside = (place >= 0) & (place < len(h))
        gain = (inside & (h[np.where(inside, place, 0)] == words[:, None])) * weight[:, None]
        total = np.zeros(drift + 2)  # by start: of the template's words so far, the most that agrees up to the text's place there
        for row in gain:
            total[:-1] = np.maximum.accumulate(np.maximum(total[:-1] + row, total[1:]))
        return float(total.max())


def _starts(starts: np.ndarray, places: np.ndarray, weights: np.ndarray, drift: int, need: float):
    """Starts from which on, within `drift`, the template's places that have votes weigh `need` or more."""
    # runs of votes with gaps above the drift can be judged apart; most weigh too little
    order = np.lexsort((places, starts))
    starts, places = starts[order], places[order]
    run = np.cumsum(np.diff(starts, prepend=starts[0]) > drift)
    heavy = np.bincount(run, weights[places]) >= need
    keep = heavy[run]
    starts, places = starts[keep].tolist(), places[keep].tolist()
    held: dict[int, int] = {}
    total, end = 0.0, 0
    for i, (start, place) in enumerate(zip(starts, places)):
        while end < len(starts) and starts[end] <= start + drift:
            p = places[end]
            held[p] = held.get(p, 0) + 1
            if held[p] == 1:
                total += weights[p]
            end += 1
        if total >= need - 1e-9 and (not i or starts[i - 1] < start):
            yield start
        held[place] -= 1
        if not held[place]:
            del held[place]
            total -= weights[place]


def _places(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Positions where the words of the phrase stand consecutively."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:n] == phrase[0])
    for k, w in enumerate(phrase[1:], 1):
        at = at[h[at + k] == w]
    return at


def _occurs(h: np.ndarray, phrase: np.ndarray) -> bool:
    return len(_places(h, phrase)) > 0


def _scan(batches, index: Index):
    base = [(_hashes(p), label) for p, label in BASE.items()]
    for batch in batches:
        for first, data, at in pieces(batch.column("text")):
            docs = len(at) - 1
            h, _, _, rows = word_hashes(data, at, CLASSES)
            n_base, low, high = np.zeros(docs, np.int64), np.full(docs, 1 << 62, np.int64), np.full(docs, -1, np.int64)
            labels: list[set[str]] = [set() for _ in range(docs)]
            for words, label in base:
                p = _places(h, words)
                doc = np.searchsorted(rows, p, "right") - 1
                p, doc = (x[p + len(words) <= rows[doc + 1]] for x in (p, doc))  # not across texts
                np.add.at(n_base, doc, 1)
                np.minimum.at(low, doc, p - rows[doc])
                np.maximum.at(high, doc, p - rows[doc])
                for d in np.unique(doc):
                    labels[d].add(label)
            base_labels = [",".join(sorted(x)) for x in labels]
            score = (n_base > 0).astype(float)
            place = np.minimum(np.searchsorted(index.words, h), len(index.words) - 1)
            hits = np.flatnonzero(index.words[place] == h)
            word, owner = place[hits], np.searchsorted(rows, hits, "right") - 1
            for low_doc in range(0, docs, 512):
                lo, hi = np.searchsorted(owner, [low_doc, low_doc + 512])
                some = index.possible(owner[lo:hi] - low_doc, word[lo:hi], min(512, docs - low_doc))
                for d in np.flatnonzero(some.any(1)) + low_doc:
                    a, b = np.searchsorted(owner, [d, d + 1])
                    own, best = index.labels(h[rows[d] : rows[d + 1]], hits[a:b] - rows[d], word[a:b], some[d - low_doc])
                    labels[d] |= own
                    score[d] = max(score[d], best)
            some = n_base > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, docs), pa.array(np.diff(rows)), pa.array(n_base), pa.array(low, mask=~some), pa.array(high, mask=~some), pa.array(base_labels, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def scan_licenses(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text; others are ignored).

    Base: places where the words of a phrase of BASE stand consecutively; first_word and last_word are the least and largest of
    their positions, null without any. The method adds the labels of the passages that a file's words of highest IDF lead to
    (see Index.labels); how rare a word is comes from all documents. score is 1 with a base place, else the best passage's agreeing
    weight; on ties all labels stand. A null or empty text has no words, no labels and score 0; of a very long one every word
    is read, half a megabyte of short texts or one long one at a time; rows are independent, so repeated rows get equal results; an
    empty table gives no rows.
    """
    index = Index(inverse_frequencies(docs), least)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(lambda it: tidy(_scan(it, index)), schema)
