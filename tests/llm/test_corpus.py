import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recframe.llm.decontaminate import Size, drop_leaks, find_leaks, simhash
from recframe.llm.line_dedup import BOILERPLATE_SQL, drop_boilerplate
from recframe.llm.mixing import TAKEN_SQL, mix, mix_digest, splitting_tree, targets
from recframe.llm.quality import QUALITY_SQL, judge_quality
from recframe.llm.secrets import scan_secrets, secrets_sql
from recframe.llm.tokens import encode, id_width, token_files
from tests.llm.helpers import frame, odd_rows, same, sentence, shingles, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sql_rows(rows, sql):
    import pandas as pd

    con = duckdb.connect()
    table = pd.DataFrame([(i, t, lang, s) for i, t, lang, s in rows], columns=["doc_id", "text", "lang", "source"])
    table["doc_id"] = table["doc_id"].astype("Int64")
    con.register("given", table)
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, lang, CAST(source AS VARCHAR) AS source FROM given")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def line_rows():
    rng = random.Random(6)
    rows = odd_rows()
    for i in range(60):
        body = [sentence(rng, 12) for _ in range(rng.randrange(1, 8))]
        body += ["The same  Footer"] * (i % 3 == 0) + [" the same footer "] * (i % 5 == 0) + [body[0]] * (i % 4 == 0)
        rng.shuffle(body)
        rows.append((500 + i, "\n".join(body), "en", f"s{i % 2}"))
    rows += [(600 + i, "the same footer\nshort own words " + sentence(rng, 20), "en", "s0") for i in range(12)] + [(620, "the same footer\n" * 30, "en", "s0")]
    return rows + [(630, ("a b c d e f g h i " * 3 + sentence(rng, 30)), "en", "s1"), (631, "x " * 9, "en", "s1"), (632, "a\n\n \nb\na\n#*$%&|<>", "en", "s1")]


@pytest.mark.parametrize("run,sql", [(judge_quality, QUALITY_SQL), (drop_boilerplate, BOILERPLATE_SQL), (scan_secrets, secrets_sql()), (lambda d: mix_digest(d).select("doc_id", "size", "source_size", "taken"), TAKEN_SQL)], ids=["quality", "lines", "secrets", "mixing"])
def test_against_sql(spark, run, sql):
    rows = line_rows()
    names, expected = sql_rows(rows, sql)
    out = run(frame(spark, rows))
    assert sorted(names) == sorted(out.columns)
    same([tuple(r[c] for c in names) for r in out.collect()], expected)
    assert run(frame(spark, rows).limit(0)).collect() == []


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))), "en", "s0") for i in range(60)]
    for r in judge_quality(frame(spark, rows)).collect():
        w = rows[r["doc_id"]][1].split()
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert r["n_repeat_words"] == len({i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)})


def leak_rows(seed=11):
    rng = random.Random(seed)
    items = [(i, sentence(rng, n)) for i, n in enumerate([3, 5, 12, 18, 25, 33, 40, 52, 60, 90, 300])] + [(20, None), (21, ""), (22, "--"), (None, sentence(rng, 30))]
    rows = odd_rows()
    for k in range(80):
        i, item = rng.choice([x for x in items if words(x[1])])
        w = item.split()
        kind = k % 4
        if kind == 1 and len(w) > 30:
            w[len(w) // 2] = "changed"
        if kind == 2:
            w = w[: len(w) // 2] + ["cut"]
        if kind == 3:
            w = [x.title() + "," for x in w]
        rows.append((700 + k, sentence(rng, rng.randrange(0, 80)) + " " + " ".join(w) + " " + sentence(rng, rng.randrange(0, 80)), "en", "s0"))
    return rows, items


def brute_leaks(rows, items, least=0.8):
    out = []
    for i, t, *_ in rows:
        w = words(t)
        for j, item in items:
            v = words(item)
            if not v:
                continue
            a, best = Counter(shingles(v, min(5, len(v)))), 0.0
            for s in range(len(w) - len(v) + 1):
                b = Counter(shingles(w[s : s + len(v)], min(5, len(v))))
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= least:
                out.append((i, j, round(best, 9)))
    return out


def test_leaks_against_brute_force(spark):
    rows, items = leak_rows()
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    df = frame(spark, rows)
    found = [(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in find_leaks(df, benchmark).collect()]
    expected = brute_leaks(rows, items)
    whole = [x for x in expected if x[2] == 1]
    assert not Counter(found) - Counter(expected) and not Counter(whole) - Counter(found)
    assert len(found) >= 0.95 * len(expected) and len(whole) > 20
    clean = drop_leaks(df, benchmark)
    assert clean.columns == df.columns and clean.count() == len(rows) - sum(any(x[0] == i for x in found) for i, *_ in rows if i is not None) - sum(x[0] is None for x in found)
    none = benchmark.limit(0)
    assert find_leaks(df, none).collect() == [] and drop_leaks(df, none).count() == len(rows) and find_leaks(df.limit(0), benchmark).collect() == []


def test_the_index_gives_all_within_the_radius():
    rng = np.random.default_rng(5)
    items = [(i, rng.integers(0, 2**63, 20, dtype=np.uint64)) for i in range(30)]
    size = Size(items, 20, 11)
    prints = np.array([simhash(h) for _, h in items], np.uint64)
    windows = np.concatenate([prints ^ np.bitwise_or.reduce([np.uint64(1) << b.astype(np.uint64) for b in rng.integers(0, 64, (k, 30))]) for k in range(1, 15)] + [rng.integers(0, 2**63, 3000, dtype=np.uint64)])
    got = set(zip(*map(np.ndarray.tolist, size.near(windows, np.ones(len(windows), bool)))))
    assert got == {(w, i) for i, p in enumerate(prints) for w in np.flatnonzero(np.bitwise_count(windows ^ p) <= 11).tolist()} and len(got) > 200


def test_targets_stop_at_their_limits():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randrange(0, 1000) for _ in range(rng.randrange(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        left, open_, goal = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
        while open_:  # share, stop those above, share again
            share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
            over = {i for i in open_ if share[i] > 2 * sizes[i]}
            for i in over or open_:
                goal[i] = 2.0 * sizes[i] if over else share[i]
            left -= sum(goal[i] for i in over)
            open_ = open_ - over if over else set()
        assert targets(sizes, weights) == pytest.approx(goal)


def test_splitting_tree():
    quotas = [500, 40, 3, 0, 211]
    tree = splitting_tree(quotas, 13, 5)
    assert tree.sum(1).tolist() == quotas and (tree >= 0).all()
    assert tree.sum(0).max() - tree.sum(0).min() <= math.ceil(math.log2(13))
    assert (tree == splitting_tree(quotas, 13, 5)).all() and (tree != splitting_tree(quotas, 13, 6)).any()
    mean = np.mean([splitting_tree(quotas, 13, s) for s in range(300)], 0)
    assert np.allclose(mean, np.outer(quotas, tree.sum(0)) / sum(quotas), atol=2.5)
    assert splitting_tree([], 4, 1).shape == (0, 4) and splitting_tree([0, 0], 4, 1).sum() == 0


def test_mix_takes_what_the_digest_says(spark):
    rng = random.Random(12)
    rows = [(1000 + i, sentence(rng, rng.randrange(1, 40)), "en", rng.choice(["a", "b", "c", None, "ü", "Z"])) for i in range(600)] + odd_rows()[12:]
    df = frame(spark, rows)
    digest = mix_digest(df, shards=5, block_words=300).collect()
    assert len(digest) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in digest)
    made = mix(df, shards=5, block_words=300)
    assert made.columns == [*df.columns, "_mix_shard"]
    got = Counter((r["doc_id"], r["_mix_shard"]) for r in made.collect())
    assert got == Counter((r["doc_id"], int(s)) for r in digest for s in r["shards"].split(",") if s)
    by_source = defaultdict(lambda: [0, 0.0])
    source = {i: s for i, _, _, s in rows}
    for r in digest:
        if r["doc_id"] is not None:
            by_source[source[r["doc_id"]]][0] += r["taken"]
            by_source[source[r["doc_id"]]][1] = r["target"]
    assert all(abs(by_source[s][0] - by_source[s][1]) <= 45 for s in ("a", "b", "c", "Z", "ü"))
    same(digest, mix_digest(df.repartition(7), shards=5, block_words=300).collect())
    assert mix(df.limit(0)).collect() == []


TEXTS = ["a\x1cb c", "ΑΣ ΟΔΟΣ", "it's  don't", "é ́x", "<|endoftext|>a b<|endoftext|> c", " x  y\x85z\xa0w　", "", "1234 ab12", "a~b ~ ~~ c", "ªº µ. İ. ŉx, ﬁ. Ω. K. ÀÉß. ÿ, .. , a., b,. ß ẞ.", "日本語 テスト", "\U0001f600 ok", "A" * 5000]


def test_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(VOCABULARY), random.Random(2)
    alphabet = "abcdeÉéßÿĀΣς.,'~<|>\x1ć \n\t\xa0½٣日"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=60)) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts, VOCABULARY)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(TEXTS, path)] == [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert id_width(path) == 2


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    rows = odd_rows() + [(800 + i, t, "en", "s0") for i, t in enumerate(TEXTS)]
    out = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files(frame(spark, rows), VOCABULARY).collect()), key=lambda r: r[0])
    start, expected = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert out == expected and id_width(VOCABULARY) == 2
    assert token_files(frame(spark, rows).limit(0), VOCABULARY).collect() == []


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    rows, items = leak_rows()
    rows = [(i if i is not None else 9999, t, lang or "en", s) for i, t, lang, s in dict.fromkeys(rows)]
    rows += [(2000 + k, rows[0][1] + " " + sentence(rng, 2), "en", "s0") for k in range(5)] + [(2010, "12 34", "en", "s0")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(out := f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(out)
        seen.append(docs.collect())
    langs, near, clean, mixed, tokens = seen
    assert {r["doc_id"] for r in langs} == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    kept, texts = {r["doc_id"] for r in near}, {r["doc_id"]: r["text"] for r in langs}
    sets = {i: set(shingles(words(t))) for i, t in texts.items()}
    linked = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    assert all(i in kept or any(linked(sets[i], sets[j]) for j in sets if j != i) for i in sets)
    assert not any(linked(sets[a], sets[b]) for a in kept for b in kept if a < b)
    leaks = {x[0] for x in brute_leaks([(r["doc_id"], r["text"], "", "") for r in near], items)}
    assert {r["doc_id"] for r in clean} >= kept - leaks and len({r["doc_id"] for r in clean} & leaks) <= 0.05 * len(leaks)
    assert all(set(r.asDict()) == set(langs[0].asDict()) for r in mixed) and max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    assert Counter(r["doc_id"] for r in tokens) == Counter(r["doc_id"] for r in mixed)
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(tokens)
    assert [r["doc_id"] for r in sorted(tokens, key=lambda r: r["start"])] == [r["doc_id"] for r in mixed]
    assert F is not None


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, empty texts, repeated rows and names that operators use: every stage has a defined result."""
    import corpus_pipeline

    rows, items = leak_rows(5)
    rows += [rows[3]] * 3 + [(None, rows[5][1], None, None)] * 2 + [(None, None, None, None)] * 2
    frame(spark, rows).withColumn("_mix_size", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(out := f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(out)
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        seen.append(docs.collect())
    langs, near, clean, mixed, tokens = seen
    assert Counter((r["doc_id"], r["text"]) for r in langs) == Counter((i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or ""))
    # copies are one, whatever their doc_ids; a null one isn't preferred
    texts = {tuple(words(r["text"])) for r in langs}
    assert len({tuple(words(r["text"])) for r in near}) == len(near) <= len(texts)
    assert not any(r["doc_id"] is None for r in near if any(x["doc_id"] is not None and words(x["text"]) == words(r["text"]) for x in langs))
    held = {t for i, t, *_ in rows if brute_leaks([(i, t, "", "")], [x for x in items if words(x[1])])}
    assert {r["text"] for r in clean} == {r["text"] for r in near} - held
    assert {r["text"] for r in mixed} <= {r["text"] for r in clean} and len(tokens) == len(mixed) > 0
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(repr, tokens))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    frame(spark, odd_rows()).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
