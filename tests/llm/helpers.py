"""Small tables with every odd case, and words as the near-duplicate operators see them."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, sid string, score double, target string, full int, host string, label string"
_FOLD = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(_FOLD))


def shingles(w, n=5):
    return list(zip(*[w[k:] for k in range(n)])) if len(w) >= n else [tuple(w)] if w else []


def sentence(rng, n):
    return " ".join("".join(rng.choice("abdeginorstu") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def odd_rows(seed=1):
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(seed)
    base = [sentence(rng, 60) for _ in range(12)]
    rows = [(i, t, "en" if i % 2 else "xx", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s1"), (20, base[0], "en", "s1"), (21, base[1] + " tail", "xx", None), (22, base[1], "xx", "s0")]
    rows += [(30, None, "en", "s0"), (31, "", None, "s1"), (32, " \n\t ", "en", None), (33, "123 456", "en", "s2"), (None, base[2], "en", "s0"), (None, None, None, None), (34, "one two", "en", "s2"), (35, "%%% ---", "en", "s2")]
    rows += [(40, sentence(rng, 20_000), "en", "s0"), (41, "word " * 3000, "en", "s1")]
    return rows


def frame(spark, rows):
    full = [(i, t, lang, s, len(t or ""), 7, "k", "x", 0.5, "t", 3, "h", "l") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def same(a, b):
    """Rows as multisets."""
    assert sorted(map(repr, a)) == sorted(map(repr, b))
