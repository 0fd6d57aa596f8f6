import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recframe.llm.common import word_hash, word_hashes
from recframe.llm.graph import components
from recframe.llm.jaccard_join import choose_banding, choose_bands, drop_near_copies, jaccard_join, recall
from tests.llm.helpers import frame, odd_rows, sentence, shingles, words


def test_bands_reach_the_target():
    n = choose_bands(0.8)
    assert recall(0.8, n, 7) >= 0.9999 > recall(0.8, n - 1, 7)


def test_bands_and_rows_are_chosen_for_the_target():
    assert choose_banding(0.8) == (40, 7)
    for similarity in (0.5, 0.7, 0.8, 0.9):
        for target, most in ((0.9, 20), (0.999, 40), (0.9999, 200)):
            bands, rows = choose_banding(similarity, target, most)
            assert recall(similarity, bands, rows) >= target and (bands <= most or rows == 1)
            assert recall(similarity, most, rows + 1) < target


def test_word_hashes_follow_words():
    texts = ["Élan VITAL, élan vital", "a-b c", "", "ünï 12x"]
    raw = "".join(texts).encode()
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, _, _, rows = word_hashes(np.frombuffer(raw, np.uint8), at)
    got = [h[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
    assert got == [[word_hash(w) for w in words(t)] for t in texts]


def brute(rows):
    sets = [frozenset(shingles(words(t))) for _, t, *_ in rows]
    near = lambda a, b: bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)
    links = [sum(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if near(a, sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return links, group


def near_rows(seed=2):
    """Chains of copies that differ more and more, one large group, exact copies and passages that many share."""
    rng = random.Random(seed)
    rows, passage = [], sentence(rng, 30)
    for k in range(6):
        w = sentence(rng, 150).split()
        for j in range(25 if k == 0 else 5):
            rows.append((len(rows), " ".join(w), "en", f"s{k % 2}"))
            for _ in range(1 + k):
                w[rng.randrange(len(w))] = sentence(rng, 1)
    rows += [(len(rows) + i, sentence(rng, 60) + " " + passage + " " + sentence(rng, 60), "en", "s0") for i in range(20)]
    rows += [(900 + i, rows[3][1].upper().replace(" ", ",\n"), "en", "s1") for i in range(4)]
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), near_rows()], ids=["odd", "near"])
@pytest.mark.parametrize("block,whole", [(400, None), (4, None), (3, 1)], ids=["whole", "blocks", "buckets"])
def test_links_and_classes_against_brute_force(spark, rows, block, whole):
    out = jaccard_join(frame(spark, rows), block=block, whole_blocks=whole).collect()
    links, group = brute(rows)
    assert Counter((r["doc_id"], r["n_links"]) for r in out) == Counter((i, n) for (i, *_), n in zip(rows, links))
    known = [(i, g) for (i, *_), g in zip(rows, group) if i is not None]
    least = {g: min(i for i, x in known if x == g) for _, g in known}
    assert {(r["doc_id"], r["class_id"]) for r in out if r["doc_id"] is not None} == {(i, least[g]) for i, g in known}


def test_one_of_each_class_stays(spark):
    rows = odd_rows() + [(i + 100, t, lang, s) for i, t, lang, s in near_rows()]
    df = frame(spark, rows)
    kept = drop_near_copies(df)
    assert kept.schema == df.schema
    _, group = brute(rows)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    member = {(i, t): g for (i, t, *_), g in zip(rows, group)}
    assert len(got) == len(set(group)) and len({member[x] for x in got if words(x[1])}) == sum(bool(words(t)) for _, t in got)


def test_empty_tables(spark):
    none = frame(spark, odd_rows()).limit(0)
    assert jaccard_join(none).collect() == [] and drop_near_copies(none).collect() == []


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(5001, 5400)] + [(7, 7), (6001, 6001)]
    label = {x: x for p in links for x in p}
    for _ in range(len(links)):
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    df = spark.createDataFrame(links + [(None, 3)], "u long, v long")
    assert {(r["node"], r["label"]) for r in components(df).collect()} == set(label.items())
    assert components(df.limit(0)).count() == 0
    assert components(df.select(F.col("u").cast("string").cast("binary").alias("u"), F.col("v").cast("string").cast("binary").alias("v"))).select("label").distinct().count() == len(set(label.values()))
