"""Cases that an operator once did only in part."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recframe.llm import common
from recframe.llm.decontaminate import drop_leaks, find_leaks
from recframe.llm.license_texts import PASSAGES
from recframe.llm.licenses import Index, _hashes, _occurs, scan_licenses, vocabulary
from recframe.llm.jaccard_join import drop_near_copies
from recframe.llm.language import keep_identified, mixtures
from recframe.llm.mixing import mix
from recframe.llm.page_text import Weights, best_region, main_text, tokens
from tests.llm.helpers import frame, sentence, shingles, words
from tests.llm.test_corpus import brute_leaks


def near_threshold(seed=21):
    """Items with a few words replaced, within other words: similarity 0.8 to 0.85 only."""
    rng = random.Random(seed)
    items, rows = [], []
    for i in range(150):
        n, edits = ((rng.randrange(49, 53), 1), (100, 2), (150, 3))[i % 3]
        items.append((i, sentence(rng, n)))
        w = items[-1][1].split()
        for e in range(edits):
            w[(2 * e + 1) * n // (2 * edits)] = "replaced"
        rows.append((i, " ".join([sentence(rng, 40), *w, sentence(rng, 40)]), "en", "s0"))
    return rows, items


def test_leaks_near_the_threshold(spark):
    rows, items = near_threshold()
    expected = [x for r in rows for x in brute_leaks([r], [items[r[0]]])]
    assert len(expected) > 140 and all(0.8 <= x[2] <= 0.85 for x in expected)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(frame(spark, rows), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in found) == sorted(expected)
    assert drop_leaks(frame(spark, rows), benchmark).count() == len(rows) - len(expected)


def test_leaks_of_repeated_words(spark):
    """Shingles that an item or a text holds several times count as often as both do."""
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))) for i in range(30)]
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 200))), "en", "s0") for i in range(30)] + [(40 + i, f"x {t} a b {t}", "en", "s0") for i, t in items]
    found = find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in found) == sorted(brute_leaks_to_the_end(rows, items))


def brute_leaks_to_the_end(rows, items, least=0.8):
    """As brute_leaks, and windows also hold what is left of the text."""
    out = []
    for i, t, *_ in rows:
        for j, item in items:
            v = words(item)
            k = min(5, len(v))
            a, s = Counter(shingles(v, k)), shingles(words(t), k) if len(words(t)) >= k else []
            bags = [Counter(s[b : b + len(v) - k + 1]) for b in range(len(s))]
            best = max((sum((a & b).values()) / sum((a | b).values()) for b in bags), default=0)
            if best >= least:
                out.append((i, j, round(best, 9)))
    return out


def test_leaks_in_texts_shorter_than_the_item(spark):
    rng = random.Random(31)
    items = [(i, sentence(rng, n)) for i, n in enumerate((52, 52, 30, 24, 12, 100))]
    cuts = {"inner": lambda w: w[: len(w) // 2] + w[len(w) // 2 + 1 :], "last": lambda w: w[:-1], "first": lambda w: w[1:], "two": lambda w: w[1:-1]}
    rows = [(10 * i + k, " ".join(cut(t.split())), "en", "s0") for i, t in items for k, cut in enumerate(cuts.values())]
    rows += [(100 + i, sentence(rng, 20) + " " + " ".join(t.split()[: -(len(t.split()) // 7)]), "en", "s0") for i, t in items]
    expected = brute_leaks_to_the_end(rows, items)
    assert {(0, 0), (1, 0), (2, 0), (103, 3)} <= {x[:2] for x in expected} and len(expected) > 20
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(frame(spark, rows), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in found) == sorted(expected)
    assert drop_leaks(frame(spark, rows), benchmark).count() == len(rows) - len({x[0] for x in expected})


BODY = "<h1>Title of the page</h1>" + "".join(f"<p>{'these are words of the article ' * 3}{i}</p>" for i in range(6))


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="layout has-sidebar">{BODY}</div></body>',
        f'<body><div class="sidebar-right page">{BODY}</div></body>',
        f'<body><div class="post comments-open"><article>{BODY}</article></div></body>',
        f'<body><form id="aspnetForm"><nav>menu entry</nav>{BODY}</form></body>',
        f'<body><div class="widget"><article>{BODY}</article></div></body>',
        f'<body><div class="menu"><p>of the menu</div><main><p class="notice">Look here{BODY}</main></body>',
        f'<body><ul><li class="promo">Buy this</ul>{BODY}</body>',
        f'<body><div><div class="ad">Buy this</div><p class="notice">Look</div>{BODY}</body>',
        f'<body><article>{BODY}</article><div id="comments">{"a reader writes on " * 100}</div><div class="site-footer">end</div></body>',
        f'<body><article>{BODY}</article><section id="comments"><article>{"a reader writes on " * 9}</article></section></body>',
        f'<body><div class="page has-sidebar nav-open">{BODY}</div></body>',
        f'<body><article><p class="share">Share this{BODY}</article></body>',
        BODY.replace("<p>", '<p class="related work">', 1).join(("<body><article>", "</article></body>")),
        f'<body><article><section id="comments-on-method">{BODY}</section></article></body>',
        f'<body><article>{BODY}<p class="ad">Buy this</p><p class="related share">See also</article></body>',
    ],
)
def test_side_elements_dont_take_the_article(page):
    text = main_text(page, Weights({}))
    expected = main_text(f"<article>{BODY}</article>", Weights({}))
    assert expected.count("\n") == 6 and text == expected


def test_articles_of_structural_tags():
    title, short = "A title of eight words for this page", "A short last paragraph"
    lines = [f"{i} words of a paragraph that stands in an element of its own" for i in range(5)]
    plain = "\n".join([title, *lines, short])
    outside = {("tag", "p"): (900, 10), ("text", "p"): (9000, 90), ("tag", "article"): (0, 100), ("tag", "/article"): (0, 100)}
    for tag in ("div", "section", "center", "details", "main"):
        body = f"<h1>{title}</h1>" + "".join(f"<{tag}>{x}</{tag}>" for x in lines) + f"<p>{short}</p>"
        nested = f"<h1>{title}</h1><{tag}>" + "".join(f"<p>{x}</p>" for x in lines) + f"</{tag}><p>{short}</p>"
        for inner in (body, nested):
            for weights in (Weights({}), Weights(outside)):
                assert main_text(f"<body><nav>menu</nav><article>{inner}</article><footer>end</footer></body>", weights) == plain
    listed = f"<article><header><h1>{title}</h1></header><dl>" + "".join(f"<dt>{x}<dd>{x}" for x in lines) + f"</dl><p>{short}</article>"
    assert main_text(listed, Weights(outside)) == "\n".join([title, *(y for x in lines for y in (x, x)), short])
    mostly_outside = Weights({**outside, ("tag", "div"): (1, 500)})
    assert mostly_outside.tag("div") < 20 * mostly_outside.tag("p") < 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_licenses_with_a_word_more_or_less(spark):
    rng = random.Random(12)
    texts = [("mit", MIT), ("mit", MIT.replace("\n", "\ndnl ")), ("mit", MIT.replace("to deal", "to freely deal")), ("gpl", GPL)]
    for labels, passage, phrases in PASSAGES:
        w = passage.split()
        if len(w) < 10:
            continue
        for k in range(1, len(w), 1 + len(w) // 40):
            for edited in (w[:k] + ["inserted"] + w[k:], w[:k] + w[k + 1 :]):
                if all(" ".join(words(p)) in " ".join(words(" ".join(edited))) for p in phrases):
                    texts += [(label, " ".join(edited)) for label in labels]
    rows = [(i, f"{sentence(rng, 30)} {t} {sentence(rng, 30)}", "en", "s0") for i, (_, t) in enumerate(texts)]
    rows += [(10_000 + i, sentence(rng, 60), "en", "s0") for i in range(300)]
    rows += [(20_000, "software license the rights of copies " * 300, "en", "s0")]
    out = {r["doc_id"]: r for r in scan_licenses(frame(spark, rows)).collect()}
    assert len(texts) > 200 and [t for i, (label, t) in enumerate(texts) if label not in out[i]["labels"].split(",")] == []
    assert out[0]["score"] == pytest.approx(1) and all(out[i]["labels"] == "" for i in out if i >= 10_000)


def test_licenses_against_all_alignments(spark):
    """Passages with words inserted, left out and replaced, alone and several in a text, against an alignment at every start."""
    rng = random.Random(3)
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.choice((1, 1, 2, 3))):
            _, passage, _ = rng.choice(PASSAGES)
            w = passage.split()
            for _ in range(int(rng.choice((0, 0.05, 0.15, 0.25, 0.35)) * len(w))):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = rng.choice(([], ["word"], ["license"], ["the"]))
            parts += [sentence(rng, rng.randrange(15)), " ".join(w[rng.choice((0, 0, len(w) // 5)) :])]
        rows.append((i, " ".join(parts), "en", "s0"))
    rows += [(1000 + i, sentence(rng, 50) + " the license of the software is subject to the following conditions " * (i % 3), "en", "s0") for i in range(200)]
    out = {r["doc_id"]: r for r in scan_licenses(frame(spark, rows)).collect()}
    texts = [_hashes(t) if words(t) else np.zeros(0, np.uint64) for _, t, *_ in rows]
    known = vocabulary()
    df = np.array([sum(w in h for h in map(set, map(np.ndarray.tolist, texts))) for w in known.tolist()])
    index = Index(np.log((1 + len(rows)) / (1 + df)), 0.7)
    must_be, some = 0, 0
    for (i, *_), h in zip(rows, texts):
        least, most = set(), set()
        for t, x in enumerate(index.templates):
            for wide, labels in ((x.drift, least), (2 * x.drift, most)):
                for s in range(-len(x.words), len(h)):
                    if labels.issuperset(x.labels):
                        break
                    near = h[max(0, s - 2 * len(x.words)) : s + 4 * len(x.words)] if labels is most else h[max(0, s + x.drift - len(x.words)) : s + 2 * len(x.words)]
                    if np.isin(h[max(0, s) : s + wide + len(x.words)], x.words).sum() * 4 >= len(x.words) and all(_occurs(near, p) for p in x.phrases) and index.aligned(t, h, s, wide) >= 0.7:
                        labels.update(x.labels)
        got = set(out[i]["labels"].split(",")) - {""} - set(out[i]["base_labels"].split(","))
        assert least - set(out[i]["base_labels"].split(",")) <= got <= most, (i, least, got, most)
        must_be, some = must_be + len(least), some + len(got)
    assert must_be > 25 and some > 15
    assert all(out[i]["labels"] == "" for i in out if i >= 1000)


def test_regions_of_random_pages_against_all_runs():
    """The text of random markup is that of the best of all contiguous runs of its tokens, and of the first such."""
    rng = random.Random(17)
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(2, 25)):
            tag = rng.choice(["p", "div", "li", "h2", "b", "nav", "section", "ul", "td", "footer", "article"])
            parts.append(rng.choice([f"<{tag}>", f"</{tag}>", f"<{tag} class='{rng.choice(['x', 'ad', 'menu item', 'body'])}'>", sentence(rng, rng.randrange(1, 12)), "&amp; more", "<br>", "<!-- no -->"]))
        page, weights = " ".join(parts), Weights({("tag", "li"): (3, 40), ("text", "li"): (5, 200), ("text", "p"): (500, 3)})
        found = tokens(page)
        score = lambda x: weights.tag(x[1]) if x[0] == "tag" else -0.5 if x[0] == "aside" else len(x[2].split()) * weights.word(x[1])
        runs = [(sum(map(score, found[a:b])), -b, -a) for a in range(len(found)) for b in range(a + 1, len(found) + 1)]
        a, b = best_region([score(x) for x in found])
        best = max([x[0] for x in runs], default=0)
        assert sum(map(score, found[a:b])) == pytest.approx(max(best, 0)), page
        shown = " ".join(x[2] for x in found[a:b] if x[0] == "text")
        assert main_text(page, weights).split() == shown.replace("&amp;", "&").split()


def test_mixtures_against_a_plain_one():
    """EM, the order of languages and the penalised choice of their set, word by word and document by document."""
    rng = np.random.default_rng(8)
    penalty, rounds, seen = 2.0, 8, Counter()
    for k in (2, 3, 4):
        counts = rng.integers(1, 60, 40)
        words = np.log(rng.dirichlet(np.ones(k) * 0.3, counts.sum()).T + 1e-6).astype(np.float32)
        for d in range(40):  # many documents have a leading language, some two
            a = counts[:d].sum()
            words[d % k, a : a + counts[d] // (1 + d % 3 // 2)] += 2
        order, chosen, sure = mixtures(words, counts, penalty, rounds)
        for d in range(40):
            a = int(counts[:d].sum())
            own = [[float(words[j, a + i]) for i in range(counts[d])] for j in range(k)]
            best = [max(own[j][i] for j in range(k)) for i in range(counts[d])]
            p = [[math.exp(max(own[j][i] - best[i], -60)) for i in range(counts[d])] for j in range(k)]

            def em(langs, share, rounds):
                for _ in range(rounds):
                    total = [sum(s * p[j][i] for j, s in zip(langs, share)) for i in range(counts[d])]
                    share = [max(sum(s * p[j][i] / total[i] for i in range(counts[d])) / counts[d], 1e-9) for j, s in zip(langs, share)]
                return share, sum(math.log(max(sum(s * p[j][i] for j, s in zip(langs, share)), 1e-30)) for i in range(counts[d]))

            alone = [sum(x) for x in own]
            share, _ = em(range(k), [1 / k] * k, rounds)
            top = max(range(k), key=lambda j: alone[j])
            ranked = [top, *(j for j in sorted(range(k), key=lambda j: -share[j]) if j != top)]
            fitted, like = [1.0], alone[top] - sum(best)
            for size in range(2, k + 1):
                if share[ranked[size - 1]] * counts[d] < 1:
                    break
                begin = [share[j] for j in ranked[:size]]
                new, value = em(ranked[:size], [x / sum(begin) for x in begin], rounds // 2)
                if value - like <= penalty * math.log(counts[d] + 1):
                    break
                fitted, like = new, value
            seen[len(fitted)] += 1
            assert [int(j) for j in order[: len(fitted), d]] == ranked[: len(fitted)]
            assert np.allclose(chosen[: len(fitted), d], fitted, atol=2e-3) and chosen[len(fitted) :, d].sum() == 0
            second = sorted(alone)[-2]
            assert sure[d] == pytest.approx(1 / (1 + math.exp(-min(alone[top] - second, 50))), abs=1e-4)
    assert seen[1] > 10 and seen[2] > 10


def test_long_texts_are_hashed_in_segments(monkeypatch):
    rng = random.Random(2)
    texts = [sentence(rng, rng.choice((0, 1, 3000))) for _ in range(12)] + ["é" * 900, "x" * 5000 + " y", "", "a b " * 2000]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    whole = common.word_hashes(raw, at)
    for size in (1, 7, 1000):
        monkeypatch.setattr(common, "SEGMENT", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, common.word_hashes(raw, at)))


def test_columns_that_bear_an_operators_names(spark):
    """Names that operators use for themselves may be those of other columns."""
    rows = [(i, sentence(random.Random(i), 30), "en", f"s{i % 2}") for i in range(20)]
    df = frame(spark, rows).withColumns({c: F.lit(c) for c in ("_near_sid", "_mix_size", "_Mix_shard", "__mix", "sid_", "bands", "first_doc", "text_")})
    assert sorted(drop_near_copies(df).collect()) == sorted(df.collect())
    mixed = mix(df, shards=3)
    assert mixed.columns == [*df.columns, "___mix_shard"] and {r["__mix"] for r in mixed.collect()} == {"__mix"}
    assert drop_leaks(df, spark.createDataFrame([(1, rows[3][1], "x")], "item_id long, text string, doc_id string")).count() == 19
    assert keep_identified(df).count() == 20


def test_a_folder_that_executors_share_is_needed_on_a_cluster(spark):
    class Conf:
        def __init__(self, **own):
            self.own = own

        def get(self, name, usual=None):
            return self.own.get(name.replace(".", "_"), usual)

    class Session:
        def __init__(self, **own):
            self.conf = Conf(**own)

    assert common.shared_dir(Session(spark_checkpoint_dir="hdfs://n/x/", spark_master="yarn")).startswith("hdfs://n/x/")
    assert common.shared_dir(Session(spark_master="local[4]")).startswith("file:///")
    with pytest.raises(ValueError):
        common.shared_dir(Session(spark_master="spark://host:7077"))
