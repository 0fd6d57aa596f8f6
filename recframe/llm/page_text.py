"""HTML extraction: the maximum-scoring contiguous region of a page, where words score positive and tags negative."""

from __future__ import annotations

import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import small_batches, tidy

#: Elements whose content is never text.
_OPAQUE = "script|style|noscript|template|textarea|iframe|svg|math|select|button|title|object|canvas"
#: A comment, an opaque element with its content, a tag (attributes may quote >) or another declaration; each may be cut off by the page's end.
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<opaque>{_OPAQUE})\b(?>\"[^\"]*\"|'[^']*'|[^>\"'])*+(?:>.*?(?:</(?P=opaque)\s*>|\Z)|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
#: Tags between which words run on; all others part blocks.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that aren't the article, wherever they stand; but see tokens.
_ASIDE = frozenset("nav aside footer form menu dialog fieldset".split())
#: Names in class, id or role that say the same: whole ones, each a word of the list or several, with a place before or a kind of box after them.
_ASIDE_WORD = r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|consent|disqus|footer|hidden|masthead|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*|related|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)"
_ASIDE_NAME = re.compile(rf"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|post)[_-])?{_ASIDE_WORD}(?:[_-]{_ASIDE_WORD})*(?:[_-](?:area|bar|block|box|buttons|container|content|form|inner|links|list|section|slot|unit|wrapper))?", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_CELLS = frozenset("td th tr tbody thead tfoot".split())
#: Elements whose end tag may be left out: the tags that end them, and what else may be open within them then.
_ENDED_BY = {"p": (_BLOCK, _INLINE), **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), _INLINE | {"p", "div"})), "li": (frozenset(["li"]), _INLINE | {"p", "div"})}
_ENDED_BY |= {**dict.fromkeys(["td", "th"], (_CELLS, _INLINE | {"p", "div"})), "tr": (_CELLS - {"td", "th"}, _INLINE | {"p", "div", "td", "th"})}
_ENDS = {name: [e for e, (by, _) in _ENDED_BY.items() if name in by] for name in _BLOCK | _CELLS | {"li", "dt", "dd"}}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags and words by themselves, where no labelled page says otherwise.
_USUAL = frozenset("p h1 h2 h3 h4 h5 h6 br b i em strong a span blockquote pre code li ul ol table tr td th img figure figcaption".split())
#: The page's frame. All other tags are within articles too, so only labelled pages that hold them mostly outside make them cost more.
_FRAME = frozenset("html head body article nav aside footer form menu dialog fieldset".split())


def _elements(page: str) -> tuple[list[tuple[str, str, str]], dict[int, tuple[int, bool]]]:
    """("text", words, ""), ("open", name, attributes) and ("close", name, "") in page order; and for each element's place the place after it, and whether its own close is there.

    An element without its close ends before the tag that implies the close, before an ancestor's close or with the page.
    """
    found, ends, at = [], {}, 0
    stack: list[tuple[str, int]] = []
    many: dict[str, int] = {}  # of each name that are open

    def end(depth: int, place: int) -> None:
        for name, i in stack[depth:]:
            ends[i] = place, False
            many[name] -= 1
        del stack[depth:]

    def among(names: tuple[str, ...] | list[str], within: frozenset | None) -> int | None:
        """The depth of the innermost open element with one of the names, if only those of `within` are open in it."""
        if not any(many.get(x) for x in names):
            return None
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                return depth
            if within is not None and stack[depth][0] not in within:
                return None
        return None

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            found.append(("text", page[at : m.start()], ""))
        at = m.end()
        if m["name"] is None:
            continue
        name, place = m["name"].lower(), len(found)
        if m["close"]:
            depth = among((name,), _INLINE if name in _INLINE else None)
            if depth is not None:
                own = stack[depth][1]
                end(depth, place)
                ends[own] = place + 1, True
            found.append(("close", name, ""))
            continue
        for ended in _ENDS.get(name, ()):
            depth = among((ended,), _ENDED_BY[ended][1])
            if depth is not None:
                end(depth, place)
        found.append(("open", name, m["rest"]))
        if name not in _VOID:
            stack.append((name, place))
            many[name] = many.get(name, 0) + 1
    if at < len(page):
        found.append(("text", page[at:], ""))
    end(0, len(found))
    return found, ends


#: Elements of running text: one of these is a side element only if all its names say so.
_TEXT = frozenset("p blockquote li dt dd td th h1 h2 h3 h4 h5 h6 pre".split())


def _named_aside(name: str, rest: str) -> bool:
    found = [bool(_ASIDE_NAME.fullmatch(own)) for x in _NAMED.findall(rest) for own in next(filter(None, x), "").split()]
    return bool(found) and (all if name in _TEXT else any)(found)


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, key, text) in page order: ("tag", name or /name, ""), ("aside", name, "") for a whole side element, ("text", last tag's key, words).

    An element that holds the largest article or main element is no side element, whatever it is called. Neither is one that holds most
    of the page's words, unless an article or main element beside it holds words too, or it is a closed nav, aside, header or footer.
    """
    found, ends = _elements(page)
    mains = [(i, ends[i][0]) for i, (kind, name, _) in enumerate(found) if kind == "open" and name in ("article", "main")]
    sizes: list[int] = []

    def words(a: int, b: int) -> int:
        if not sizes:
            sizes.extend(itertools.accumulate((len(x.split()) if kind == "text" else 0 for kind, x, _ in found), initial=0))
        return sizes[b] - sizes[a]

    def holds_article(i: int) -> bool:
        end, closed = ends[i]
        held = max((words(a, b) for a, b in mains if i < a < end), default=-1)
        if held >= 0:
            return held >= max((words(a, b) - (words(i, end) if a < i < b else 0) for a, b in mains if not i < a < end), default=0)
        if closed and found[i][1] in ("nav", "aside", "header", "footer") or 2 * words(i, end) <= words(0, len(found)):
            return False
        return not any((b <= i or a >= end) and words(a, b) for a, b in mains)

    out, key, inside, i = [], "", 0, 0
    while i < len(found):
        kind, name, rest = found[i]
        i += 1
        if kind == "text":
            out.append(("text", key, name))
            continue
        if kind == "close":
            inside -= name in ("article", "main") and inside > 0
            key = f"/{name}"
            out.append(("tag", key, ""))
            continue
        side = name in _ASIDE or name == "header" and not inside
        if not side and rest and name not in ("html", "body", "article", "main") and name not in _VOID:
            side = _named_aside(name, rest)
        if side and not holds_article(i - 1):
            key = "aside"
            out.append(("aside", name, ""))
            i = ends[i - 1][0]
            continue
        inside += name in ("article", "main")
        key = name
        out.append(("tag", key, ""))
    return out


def _labelled(found: list[tuple[str, str, str]]) -> tuple[int, int] | None:
    """The tokens between a page's one article element's tags, if it says so itself."""
    opened = [i for i, (kind, key, _) in enumerate(found) if kind == "tag" and key == "article"]
    closed = [i for i, (kind, key, _) in enumerate(found) if kind == "tag" and key == "/article"]
    return (opened[0] + 1, closed[0]) if len(opened) == len(closed) == 1 and opened[0] < closed[0] else None


def _tally(batches):
    for batch in batches:
        counts: dict[tuple[str, str], list[int]] = {}
        for page in batch.column("html").to_pylist():
            found = tokens(page or "")
            span = _labelled(found)
            for i, (kind, key, text) in enumerate(found if span else ()):
                if kind != "aside":
                    n = counts.setdefault((kind, key[:40]), [0, 0])
                    n[not span[0] <= i < span[1]] += len(text.split()) if kind == "text" else 1
        yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in counts], "key": [k for _, k in counts], "inside": [a for a, _ in counts.values()], "outside": [b for _, b in counts.values()]}, pa.schema([("kind", pa.string()), ("key", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())]))


class Weights:
    """What a word after a tag (above 0, at most 1) and a tag (below 0) score. Tags count by the first 40 characters of their names: no element's name is longer."""

    def __init__(self, counts: dict[tuple[str, str], tuple[int, int]]):
        self.counts = counts

    def word(self, key: str) -> float:
        a, b = self.counts.get(("text", key[:40]), (0, 0))
        usual = 4.0 if key.removeprefix("/") in _USUAL or not key else 1.0
        return (a + usual) / (a + b + usual + 1)

    def tag(self, key: str) -> float:
        a, b = self.counts.get(("tag", key[:40]), (0, 0))
        usual = 0.5 if key.removeprefix("/") in _FRAME else 20.0
        return -0.05 - 40 * (1 - (a + usual) / (a + b + usual + 0.5)) ** 2


def fit(pages: DataFrame, most: int = 2000) -> Weights:
    """Weights from labelled pages: those with one article element, among about `most` pages chosen by the hash of page_id.

    The sample bounds what the fit reads and what comes to the driver, at any size; where no page is labelled, usual weights stand.
    """
    small_batches(pages.sparkSession)
    total = pages.count()
    share = int(min(1.0, most / max(total, 1)) * 2**31)
    sample = pages.where(F.pmod(F.xxhash64("page_id", F.lit("fit")), F.lit(1 << 31)) < share).select("html")
    rows = sample.mapInArrow(lambda it: tidy(_tally(it)), "kind string, key string, inside long, outside long").groupBy("kind", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return Weights({(r["kind"], r["key"]): (r["inside"], r["outside"]) for r in rows})


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum above 0, in one pass; the first of equals."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best region: white space made single, joined by \\n, character references decoded."""
    found = tokens(page or "")
    scores = [weights.tag(key) if kind == "tag" else -0.5 if kind == "aside" else len(text.split()) * weights.word(key) for kind, key, text in found]
    blocks, block = [], []
    a, b = best_region(scores)
    for kind, key, text in found[a:b]:
        if kind == "text":
            block.append(html.unescape(text) if "&" in text else text)
        elif kind == "aside" or key.removeprefix("/") not in _INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return "\n".join(x for x in (" ".join(block.split()) for block in blocks) if x)


def _extract(batches, weights: Weights):
    cached = Cache(weights)
    for batch in batches:
        text = [main_text(page, cached) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


class Cache:
    """Weights that are worked out once a key."""

    def __init__(self, weights: Weights):
        self._tag, self._word, self._weights = {}, {}, weights

    def tag(self, key: str) -> float:
        if key not in self._tag:
            self._tag[key] = self._weights.tag(key)
        return self._tag[key]

    def word(self, key: str) -> float:
        if key not in self._word:
            self._word[key] = self._weights.word(key)
        return self._word[key]


def extract(pages: DataFrame, most: int = 2000) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html; others are ignored).

    text: the page's article without menus, page headers, footers, sidebars, notices, adverts, forms, comments and markup, from the
    whole html; empty where html is null, empty or holds no words. A very long page is parsed whole, in Python objects of some 300 bytes
    a tag or run of text; an empty table gives no rows. n_chars: the text's code points. Side elements (see tokens) are left out wherever
    they stand; of the rest the best contiguous region by the fitted weights is taken, the first on ties. Pages are independent,
    so repeated rows get equal rows. Weights come from labelled pages (see fit).
    """
    weights = fit(pages, most)
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: tidy(_extract(it, weights)), "page_id long, url string, text string, n_chars long")
