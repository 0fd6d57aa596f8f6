"""Secret scans: Boolean trigram queries from each regex, a trigram index of the texts, verification of candidates."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from re import _constants as R
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import materialise
from recframe.llm.quality import let, running_sums


@dataclass(frozen=True)
class Rule:
    """kind; pattern (of the syntax that Java, RE2 and Python share); group and least: matches whose group (0: all) is shorter than that are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False


#: The base rules, then the method's own for public token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 0),
)

# ---------------------------------------------------------------- from a regex to a Boolean query of trigrams

#: A query is True (nothing is mandatory), a trigram, or ("and" | "or", queries).
Query = object
#: Sets of strings above these sizes are summed up by their trigrams and ends.
MOST_EXACT, MOST_ENDS = 24, 24


def _all(queries) -> Query:
    own = frozenset(itertools.chain.from_iterable(q[1] if isinstance(q, tuple) and q[0] == "and" else [q] for q in queries if q is not True))
    return True if not own else next(iter(own)) if len(own) == 1 else ("and", own)


def _any(queries) -> Query:
    own = frozenset(itertools.chain.from_iterable(q[1] if isinstance(q, tuple) and q[0] == "or" else [q] for q in queries))
    if True in own:
        return True
    parts = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in own}
    own = frozenset(q for q, x in parts.items() if not any(y < x for y in parts.values()))  # what a weaker one implies adds nothing
    return next(iter(own)) if len(own) == 1 else ("or", own)


def _grams(text: str) -> Query:
    """What a text that holds this string holds."""
    return _all(text[i : i + 3] for i in range(len(text) - 2))


@dataclass(frozen=True)
class _Known:
    """What is known of every string that a part of a regex matches (lower case): all of them, or how they begin and end, and a query that they satisfy."""

    exact: frozenset[str] | None
    begin: frozenset[str]
    end: frozenset[str]
    query: Query

    @classmethod
    def of(cls, strings) -> _Known:
        strings = frozenset(strings)
        return cls(strings, strings, strings, True).short()

    def short(self) -> _Known:
        """The same with sets of bounded sizes: what is cut off of them goes into the query first."""
        exact, begin, end, query = self.exact, self.begin, self.end, self.query
        if exact is not None:
            if len(exact) <= MOST_EXACT:
                return _Known(exact, exact, exact, True)
            query = _any(_grams(x) for x in exact)
        query = _all([query, _any(_grams(x) for x in begin), _any(_grams(x) for x in end)])
        cut = lambda xs, side, n: frozenset(side(x, n) for x in xs)
        for n in (2, 1, 0):
            begin = begin if len(begin) <= MOST_ENDS and all(len(x) <= 2 for x in begin) else cut(begin, lambda x, k: x[:k], n)
            end = end if len(end) <= MOST_ENDS and all(len(x) <= 2 for x in end) else cut(end, lambda x, k: x[len(x) - min(k, len(x)) :], n)
        return _Known(None, begin, end, query)

    def then(self, other: _Known) -> _Known:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST_EXACT:
            return _Known.of(a + b for a in self.exact for b in other.exact)
        both = lambda xs, ys: frozenset(a + b for a in xs for b in ys)
        # what stands where the two meet is in every match: the end of one, then the beginning of the other
        meet = True
        if len(self.end) * len(other.begin) <= 4 * MOST_EXACT:
            meet = _any(_grams(a + b) for a in self.end for b in other.begin)
        begin = both(self.exact, other.begin) if self.exact is not None and len(self.exact) * len(other.begin) <= MOST_ENDS else self.begin
        end = both(self.end, other.exact) if other.exact is not None and len(self.end) * len(other.exact) <= MOST_ENDS else other.end
        query = [meet]
        for x in (self, other):
            query.append(x.query if x.exact is None else _any(_grams(t) for t in x.exact))
        return _Known(None, begin, end, _all(query)).short()

    def or_else(self, other: _Known) -> _Known:
        if self.exact is not None and other.exact is not None:
            return _Known.of(self.exact | other.exact)
        query = _any(x.query if x.exact is None else _any(_grams(t) for t in x.exact) for x in (self, other))
        return _Known(None, self.begin | other.begin, self.end | other.end, query).short()

    def found(self) -> Query:
        """The query that every text with a match satisfies."""
        if self.exact is not None:
            return _any(_grams(x) for x in self.exact)
        return _all([self.query, _any(_grams(x) for x in self.begin), _any(_grams(x) for x in self.end)])


_NOTHING = _Known.of([""])
#: A part of which nothing is known: it may be empty, or anything.
_ANYTHING = _Known(None, frozenset([""]), frozenset([""]), True)


def _characters(items) -> _Known:
    """One of a set of characters, in lower case; too many, or a set that isn't a plain one, are anything."""
    found: set[str] = set()
    for op, value in items:
        if op is R.LITERAL:
            found.add(chr(value).lower())
        elif op is R.RANGE:
            if value[1] - value[0] > 256:
                return _ANYTHING
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return _ANYTHING
    return _Known.of(found) if all(len(x) == 1 for x in found) else _ANYTHING


def _known(nodes) -> _Known:
    """What is known of a parsed sequence. Whatever isn't understood here counts as anything, which never loses a match."""
    out = _NOTHING
    for op, value in nodes:
        if op is R.LITERAL:
            part = _characters([(op, value)])
        elif op is R.IN:
            part = _characters(value)
        elif op is R.SUBPATTERN:
            part = _known(value[-1])
        elif op is R.BRANCH:
            part = reduce(_Known.or_else, (_known(x) for x in value[1]))
        elif op in (R.MAX_REPEAT, R.MIN_REPEAT, R.POSSESSIVE_REPEAT):
            least, most, body = value
            own = _known(body)
            if (least, most) == (0, 1):
                part = own.or_else(_NOTHING)
            else:
                part = reduce(_Known.then, [own] * min(least, 4), _NOTHING)
                if most is R.MAXREPEAT or most > min(least, 4):
                    part = part.then(_ANYTHING)
                    if least:  # it ends as one of its rounds does
                        part = _Known(None, part.begin, own.end if own.exact is None else own.exact, part.query).short() if all(own.end) else part
        elif op is R.ATOMIC_GROUP:
            part = _known(value)
        elif op in (R.AT, R.ASSERT, R.ASSERT_NOT):
            part = _NOTHING
        else:
            part = _ANYTHING
        out = out.then(part)
    return out


def trigram_query(rule: Rule) -> Query:
    """What the lower-cased text of every match's document holds, derived from the parsed regex; True if nothing is mandatory."""
    return _known(_parser.parse(rule.pattern)).found()


def grams_of(query: Query) -> frozenset[str]:
    return frozenset() if query is True else frozenset([query]) if isinstance(query, str) else frozenset().union(*map(grams_of, query[1]))


def holds(query: Query, grams: Column, number: dict[str, int]) -> Column:
    """The query over the numbers of the trigrams that a text holds."""
    if isinstance(query, str):
        return F.array_contains(grams, number[query])
    return reduce(and_ if query[0] == "and" else or_, (holds(q, grams, number) for q in sorted(query[1], key=repr)))


# ---------------------------------------------------------------- index and verification


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the digest of the text as its key in the index: equal texts are one entry, whatever their doc_id."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def postings(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """trigram, key: the index, of those trigrams that the rules' queries name; the lower-cased text holds each at least once."""
    grams = sorted(frozenset().union(*(grams_of(trigram_query(r)) for r in rules)))
    held = let(F.lower("text"), lambda t: F.filter(F.array(*(F.when(F.contains(t, F.lit(g)), F.lit(i)) for i, g in enumerate(grams))), lambda x: x.isNotNull()))
    return rows.select("key", F.explode(held).alias("trigram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, kinds: the rules that a text may match, by intersecting and uniting the postings of the trigrams as the rules' queries say."""
    queries = {r.kind: trigram_query(r) for r in rules}
    number = {g: i for i, g in enumerate(sorted(frozenset().union(*map(grams_of, queries.values()))))}
    found = postings(rows, rules).groupBy("key").agg(F.collect_set("trigram").alias("grams"))
    match = [F.when(holds(q, F.col("grams"), number), F.lit(kind)) for kind, q in queries.items() if q is not True]
    if not match:
        return found.select("key", F.array().cast("array<string>").alias("kinds")).limit(0)
    return found.select("key", F.filter(F.array(*match), lambda x: x.isNotNull()).alias("kinds")).where(F.size("kinds") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """A struct of the rule's kind and rank, and of arrays over its matches, leftmost and non-overlapping: step (gap before it and match), size and judged, which are lengths in code points; null without a match."""
    sizes = lambda x: F.transform(x, lambda y: F.length(y))
    whole = sizes(F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1)))
    between = sizes(F.split(text, rule.pattern, -1))
    judged = sizes(F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1))) if rule.group else None
    rank = [r.kind for r in RULES].index(rule.kind)

    def made(size: Column) -> Column:
        steps = F.zip_with(F.slice(between, 1, F.size(size)), size, lambda x, y: x + y)
        return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(rule.least).alias("least"), steps.alias("step"), size.alias("size"), (size if judged is None else judged).alias("judged"))

    return F.when(text.rlike(rule.pattern), let(whole, made))


def spans(found: Column) -> Column:
    """start, rank, span (kind:start:end) of a rule's matches that are long enough: a match ends where the steps up to it sum to."""

    def placed(ends: Column) -> Column:
        kept = F.filter(F.arrays_zip(ends.alias("end"), found["size"].alias("size"), found["judged"].alias("judged")), lambda x: x["judged"] >= found["least"])
        return F.transform(kept, lambda x: F.struct((x["end"] - x["size"]).alias("start"), found["rank"].alias("rank"), F.concat_ws(":", found["kind"], x["end"] - x["size"], x["end"]).alias("span")))

    return let(running_sums(found["step"]), placed)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs (doc_id, text; others are ignored).

    spans: kind:start:end of all rules' matches (code points, end exclusive), comma-joined by start, then in the order of RULES;
    base_sha256 is the digest of those of the base rules alone. A null or empty text has no spans, and the digest of the empty
    string; a very long one is scanned in whole, at a cost in proportion to its length and n log n in its matches; repeated
    rows get equal rows, as results come from the text alone; an empty table gives no rows.

    The index holds the trigrams that the rules' queries name. Rules with a query are verified in the texts that the combined
    postings give; those without one scan every text. The candidates are written down, so texts stay where they are if these
    few are known to fit a broadcast; beyond that both meet by key in a join that Spark may split.
    """
    rows = _keyed(docs)
    indexed = {r.kind for r in rules if trigram_query(r) is not True}
    chosen = materialise(candidates(rows, rules))
    rows = rows.join(chosen, "key", "left")
    each = [F.when(F.array_contains("kinds", r.kind), matches(F.col("text"), r)) if r.kind in indexed else matches(F.col("text"), r) for r in rules]
    found = F.flatten(F.transform(F.filter(F.array(*each), lambda x: x.isNotNull()), spans))
    base = [i for i, r in enumerate(RULES) if r.base]
    number = {r.kind: i for i, r in enumerate(RULES)}

    def digest(found: Column) -> Column:
        count = lambda kind: F.size(F.filter(found, lambda x: x["rank"] == number[kind])).cast("long")
        joined = lambda x: F.array_join(F.transform(x, lambda y: y["span"]), ",")
        own = F.filter(found, lambda x: x["rank"].isin(base))
        return F.struct(*(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(found).alias("spans"))

    return rows.select("doc_id", let(F.sort_array(found), digest).alias("m")).select("doc_id", "m.*")


def secrets_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same spans by a full scan with every rule."""

    def scan(rank: int, r: Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        return f"""SELECT r, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, regexp_split_to_array(text, '{pattern}') AS gaps,
        regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {r.group}) AS judged FROM d WHERE regexp_matches(text, '{pattern}')"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(scan(i, r) for i, r in enumerate(rules))}),
e AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
p AS (SELECT r, kind, rank, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(found[i]) AS size FROM e WHERE length(judged[i]) >= least),
s AS (SELECT r, rank, start, kind || ':' || start || ':' || (start + size) AS span FROM p)
SELECT d.doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, d.doc_id
"""
