"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative, and one linear scan finds the contiguous
stretch with the highest sum: the content region.  The weights come from labelled pages, those whose markup names
the main text (``article``, ``main`` or the like): log odds of a word's or tag's kind inside against outside of it,
counted over all such pages in Spark and drawn towards fixed prior weights where there is little to count.

A kind is the tag's name (names that HTML does not have are one kind), or whether a word is in a link.  The mark of a labelled
page serves learning only: a page's words and tags score alike wherever they stand, so a story outside of the
``article`` elements of its page is found as well.  The marking tags themselves are not learned and keep their prior weight.

Menus, page headers, footers, sidebars, notices, adverts, forms and reader comments are known by tag, role or class name;
their words score nothing and are left out, also within the region, while their tags cost what they cost anywhere.  The
heading of a header inside the main text stays.

Text: character references are decoded, white space inside a block becomes one space, and blocks are joined in page
order by one space.

Nulls and odd rows: null, empty and wordless html has an empty text; unclosed and stray tags, comments, scripts and
quotes are tolerated; rows are extracted one by one, so repeated and null ids are fine; a table without any
labelled page uses the prior weights; input columns named text or n_chars give way to the output's.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelflow.llm.carry import carried
from parcelflow.llm.registry import query, table

#: Observations that the prior weight of a kind stands for, and the range of weights.
PRIOR_STRENGTH = 200
MOST_WEIGHT = 3.0
LEAST_WEIGHT = 0.1

# Names that HTML and common page templates give to things.
RAW = "script style noscript template iframe svg canvas object title math"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea
tfoot th thead tr ul video audio""".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font frame frameset i ins kbd label map mark meter noframes object
output picture progress q rp rt ruby s samp slot small span strike strong sub summary sup time tt u var""".split())
MARKS = {"article", "main"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
KNOWN_TAGS = BLOCKS | VOID | INLINE | set(RAW.split())
LEFT_OUT_TAGS = set("nav footer aside form button select textarea option dialog menu head search audio video".split())
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
MAIN_WORDS = set("article content post entry main story text page body wrapper container layout site".split())
LEFT_OUT_WORDS = set("""nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager header masthead topbar banner footer copyright
colophon sidebar aside widget widgets rail related recommended recommendations trending popular cookie cookies consent gdpr notice notices
popup modal overlay paywall alert ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promos promoted
promotion form search searchbox login signin signup register subscribe subscription newsletter share sharing social comment comments reply
replies respond disqus discussion hidden offscreen""".split())
STATE_WORDS = set("has no with without is js not".split())
#: Prior weights of tags by name, of other tags, and of words outside and inside of links.
TAG_WEIGHTS = {"p": 0.2, "br": 0.1, "h1": 0.3, "h2": 0.3, "h3": 0.5, "blockquote": 0.5, "pre": 0.5, "li": 1.0, "a": 1.0, "div": 1.0, "article": 3.0, "main": 3.0}
OTHER_TAG_WEIGHT, WORD_WEIGHT, LINK_WORD_WEIGHT = 0.7, 1.0, 0.2

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{"|".join(RAW.split())})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>"']++|"[^"]{{0,4000}}+"|'[^']{{0,4000}}+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/<>]*)(?P<rest2>[^<>]*)>|(?P<text>[^<]+|<)""", re.DOTALL | re.IGNORECASE | re.VERBOSE)
_UNENDED = re.compile(r"<!--|<!\[CDATA\[", re.IGNORECASE)
_TAG_START, _UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)"), re.compile(r"""[^<>"']*""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: An open p ends where one of these begins.
_ENDS_P = BLOCKS - {"br", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "head"}
_ITEM_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_ITEM_PEERS = {"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",)}


def _name_is_left_out(name: str) -> bool:
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or parts[0] in STATE_WORDS:
        return False
    if parts[0] in MAIN_WORDS:
        return len(parts) > 1 and parts[-1] in LEFT_OUT_WORDS
    return any(p in LEFT_OUT_WORDS for p in parts)


class _Element:
    __slots__ = ("tag", "out", "main", "link", "header")

    def __init__(self, tag: str, out: bool, main: str, link: bool, header: bool):
        self.tag, self.out, self.main, self.link, self.header = tag, out, main, link, header


def _open(tag: str, rest: str, above: _Element | None) -> _Element:
    out, main, link = (above.out, above.main, above.link) if above else (False, "", False)
    header = above.header if above else False
    if tag == "article" and not out:
        main = "article"
    elif tag == "main" and not out and not main:
        main = "main"
    if header and tag in HEADINGS and main:
        # the heading of the main text's own header
        return _Element(tag, False, main, link, False)
    own = tag in LEFT_OUT_TAGS
    if tag == "header":
        own = header = True
    if rest.strip(" /"):
        for key, a, b, c in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), a or b or c
            if key == "role":
                if value.lower() == "main" and not out and not main:
                    main = "main"
                own |= value.lower() in LEFT_OUT_ROLES
            elif key == "itemprop" and value.lower() == "articlebody" and not out:
                main = "article"
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                own = True
            elif key == "style":
                own |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
            elif key in ("class", "id") and tag not in ("html", "body", "main"):
                names = [n for n in value.split() if _name_is_left_out(n)]
                if names and tag == "article":
                    names = [n for n in names if re.search(r"comment|repl|sponsor|promo|\bad", n, re.IGNORECASE)]
                if names:
                    own = True
                    header |= any("header" in n.lower() for n in names)
    return _Element(tag, out or own, main, link or tag == "a", header)


def _tag_stop(page: str, at: int, failed: set[int]) -> int:
    """Where the > of a tag stands whose attributes begin at ``at``, or -1.

    ``failed`` holds opening quotes from which no > was reached, so that each is followed once.
    """
    seen = []
    while True:
        at = _UNQUOTED.match(page, at).end()
        c = page[at:at + 1]
        if c == ">":
            return at
        if c in ("'", '"') and at not in failed:
            seen.append(at)
            close = page.find(c, at + 1)
            if close >= 0:
                at = close + 1
                continue
        failed.update(seen)
        return -1


def _tokens(page: str):
    """(text, name, whether it ends an element, rest of the tag); text or name is None.

    The pattern takes quoted values up to 4000 characters; a tag that it does not take whole is followed quote by quote.
    Behind the last > no tag can end, so that only comments and character data are looked for there.
    """
    at, failed, last = 0, set(), page.rfind(">")
    while at < len(page):
        if at > last:
            rest = _UNENDED.search(page, at)
            yield page[at:rest.start() if rest else len(page)], None, None, ""
            return
        token = _TOKEN.match(page, at)
        if token["name2"] or token["text"] == "<":
            start = _TAG_START.match(page, at)
            stop = _tag_stop(page, start.end(), failed) if start else -1
            if stop >= 0:
                yield None, start[2], start[1], page[start.end():stop]
                at = stop + 1
                continue
        yield token["text"], token["name"] or token["name2"], token["end"] or token["end2"], token["rest"] or token["rest2"] or ""
        at = token.end()


def events(page: str) -> list[tuple]:
    """The page as (kind, name, main, out, words or text, block) events in order.

    Text events: ("text", link, main, out, text, block number); tag events: ("tag", name, main, out, "", block number).
    """
    found: list[tuple] = []
    stack: list[_Element] = []
    #: open elements by tag, so that stray tags do not search a deep stack
    held: Counter = Counter()
    block = 0

    def close(place: int) -> None:
        for e in stack[place:]:
            held[e.tag] -= 1
        del stack[place:]

    for text, name, ends, rest in _tokens(page):
        top = stack[-1] if stack else None
        if text is not None:
            found.append(("text", top.link if top else False, top.main if top else "", top.out if top else False, text, block))
            continue
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            block += 1
        if ends:
            if held[name] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == name))
                top = stack[-1] if stack else None
            found.append(("tag", name, top.main if top else "", top.out if top else False, "", block))
            continue
        if name in _ENDS_P and held["p"] > 0:
            # a paragraph ends unless another block has been opened inside of it
            place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in BLOCKS)
            if stack[place].tag == "p":
                close(place)
        elif name in _ITEM_SCOPE and any(held[x] > 0 for x in (name, *_ITEM_PEERS.get(name, ()))):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in _ITEM_SCOPE[name]:
                    break
                if stack[i].tag == name or stack[i].tag in _ITEM_PEERS.get(name, ()):
                    close(i)
                    break
        top = stack[-1] if stack else None
        element = _open(name, rest, top)
        found.append(("tag", name, element.main, element.out, "", block))
        if name not in VOID and not (rest.endswith("/") and name not in BLOCKS) and (name in BLOCKS or name == "a" or element.out != (top.out if top else False)):
            stack.append(element)
            held[name] += 1
    # an article speaks for its page before a main element around it
    marks = {e[2] for e in found if e[0] == "text" and not e[3]}
    mark = "article" if "article" in marks else "main" if "main" in marks else ""
    return [(*e[:2], (e[2] == mark if mark else None), *e[3:]) for e in found]


def _kind(event: tuple) -> str:
    """What an event is, wherever it stands."""
    if event[0] == "text":
        return "word-link" if event[1] else "word"
    return f"tag-{event[1]}" if event[1] in KNOWN_TAGS else "tag-*"


def count_kinds(page: str, counts: Counter) -> None:
    """Add a labelled page's words and tags to the counts of (kind, inside).

    Words left out count outside of the mark only: inside, they are neither main text nor a page's frame.
    """
    seen = events(page)
    if not any(e[2] for e in seen):
        return
    for e in seen:
        if e[0] == "text":
            if not (e[3] and e[2]):
                counts[_kind(e), bool(e[2])] += len(references.unescape(e[4]).split())
        elif e[1] not in MARKS:
            counts[_kind(e), bool(e[2])] += 1


def _prior(kind: str) -> float:
    if kind.startswith("word"):
        return LINK_WORD_WEIGHT if kind.endswith("link") else WORD_WEIGHT
    return -TAG_WEIGHTS.get(kind.removeprefix("tag-"), OTHER_TAG_WEIGHT)


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights by kind, from the counts of both sides: positive for words, negative for tags."""
    out = {}
    for kind in {k for k, _ in counts}:
        inside, outside = counts.get((kind, True), 0), counts.get((kind, False), 0)
        odds = max(-MOST_WEIGHT, min(MOST_WEIGHT, math.log((inside + 1) / (outside + 1))))
        share = (inside + outside) / (inside + outside + PRIOR_STRENGTH)
        mixed = share * odds + (1 - share) * _prior(kind)
        out[kind] = max(LEAST_WEIGHT, mixed) if kind.startswith("word") else min(-LEAST_WEIGHT, mixed)
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the highest sum (the first and shortest one), as start and stop."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    seen = events(page or "")
    scores = []
    for e in seen:
        kind = _kind(e)
        each = weights.get(kind, _prior(kind))
        if e[0] == "text":
            each = 0.0 if e[3] else each * len(references.unescape(e[4]).split())
        scores.append(each)
    start, stop = region(scores)
    blocks: dict[int, list[str]] = {}
    for e in seen[start:stop]:
        if e[0] == "text" and not e[3]:
            blocks.setdefault(e[5], []).append(references.unescape(e[4]))
    return " ".join(" ".join("".join(parts).split()) for parts in blocks.values() if "".join(parts).strip())


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Weights from all pages that name their main text; kinds are HTML's tag names and three more, so few rows come back."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                if page:
                    count_kinds(page, counts)
        kinds = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kinds], pa.string()), pa.array([i for _, i in kinds], pa.bool_()),
                                          pa.array([counts[k] for k in kinds], pa.int64())], ["kind", "inside", "n"])

    total = (pages.select("html").mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside")
             .agg(F.sum("n").alias("n")))
    return weights_from({(r["kind"], r["inside"]): r["n"] for r in total.collect()})


def extract_text(pages: DataFrame, weights: dict[str, float], *, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all but html), text and n_chars."""
    carry = carried(pages, carry, ["text", "n_chars"], drop=("html",))
    schema = T.StructType([*[pages.schema[c] for c in carry], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*carry, "text", "n_chars"])

    return pages.select(*dict.fromkeys([*carry, "html"])).mapInArrow(run, schema)


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, learn_weights(pages), carry=["page_id", "url"])
