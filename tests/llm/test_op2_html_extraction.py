import math
import random
import time
from collections import Counter

import pytest
from plain import prose

from parcelflow.llm.op2_html_extraction import count_kinds, extract_text, learn_weights, main_text, region, weights_from
from parcelflow.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"
STORY = "It was a plain day and nothing much went on in the small town by the river."


def test_region_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(-4, 5) for _ in range(rng.randrange(0, 15))]
        a, b = region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def _page(body: str) -> str:
    return f"<html><head><title>t</title><style>p {{}}</style></head><body>{body}</body></html>"


CASES = [
    # (body, text)
    (f"<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>{STORY}\n<b>bo</b>ld<br>end</p></article><footer>&copy; all of it</footer>",
     f"A & B {STORY} bold end"),
    (f"<article><header><h1>Head</h1><span>by me</span></header><p>{STORY}<p>two <script>var a='</p>';</script>three<aside>see also this</aside>",
     f"Head {STORY} two three"),
    (f"<main><p>{STORY}</p><form><label>Name</label><button>go</button></form><section class='comments'><p>{STORY} I agree</p></section></main>", STORY),
    (f"<div id=topMenu>Home News</div><div class='entry-content'><p>{STORY}</p><div class='ad-slot'>{STORY} Buy</div><p>{STORY}</p></div>"
     f"<div role=complementary>{STORY}</div><div class='cookie-notice'>{STORY}</div>", f"{STORY} {STORY}"),
    (f"<article><p>{STORY}<!-- <p>not this --></p><p hidden>nor this</p><p title='a>b'>a &lt; b &#233; &eacute; &nbsp; c</p></article>", f"{STORY} a < b é é c"),
    ("<article><p>x</p></article>", "x"),
    ("<nav>only a menu</nav>", ""),
]


@pytest.mark.parametrize(("body", "text"), CASES)
def test_pages(spark, sf, body, text):
    assert main_text(_page(body), _weights(spark, sf)) == text


_LEARNED = {}


def _weights(spark, sf):
    if not _LEARNED:
        _LEARNED.update(learn_weights(spark.read.parquet(f"{sf}/pages.parquet")))
    return _LEARNED


def test_words_are_positive_and_tags_negative(spark, sf):
    weights = _weights(spark, sf)
    assert weights["word"] > 0 and all(w < 0 for k, w in weights.items() if k.startswith("tag-"))
    assert weights["tag-li"] < weights["tag-p"]


def test_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = QUERIES["op2_html_extraction"](spark, sf).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in got)
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in got:
        inside = raw[r["page_id"]].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        for tag in ("<h1>", "</h1>", "<p>", "</p>", "<br>"):
            inside = inside.replace(tag, " ")
        import html
        assert r["text"] == " ".join(html.unescape(inside.replace("<b>", "").replace("</b>", "")).split())


def test_the_mark_does_not_decide(spark, sf):
    weights = _weights(spark, sf)
    story = " ".join([STORY] * 20)
    teasers = "".join(f"<article><a href=/{i}>Another story here</a></article>" for i in range(2))
    # the story stands outside of the page's only article elements
    for page in (f"<div><h1>Title of it</h1><p>{story}</p></div>{teasers}", f"{teasers}<div><h1>Title of it</h1><p>{story}</p></div>"):
        assert main_text(_page(page), weights) == f"Title of it {story}"
    # the same page without, with and with another mark
    body = f"<nav><ul><li><a href=/>Home</a></li></ul></nav><X><h1>Title</h1><p>{story}</p><p>{STORY}</p></X><footer>by us</footer>"
    assert {main_text(_page(body.replace("X", x)), weights) for x in ("article", "main", "section", "div")} == {f"Title {story} {STORY}"}
    assert main_text(_page(body.replace("<X>", "").replace("</X>", "")), weights) == f"Title {story} {STORY}"


def test_weights_use_both_sides_of_every_kind(spark):
    # 30 and 49 are few each, and count all the same; unknown names are one kind
    page = "<article>" + "<h4>x</h4>" * 30 + "<x-1></x-1><x-2></x-2></article>" + "<h4>x</h4>" * 49
    counts = Counter()
    count_kinds(page, counts)
    assert counts["tag-h4", True] == 60 and counts["tag-h4", False] == 98 and counts["tag-*", True] == 4 and not any("article" in k for k, _ in counts)
    weights = learn_weights(spark.createDataFrame([(1, "u", page)], PAGES))
    assert weights == weights_from(counts)
    share = 158 / 358
    assert weights["tag-h4"] == pytest.approx(share * math.log(61 / 99) - (1 - share) * 0.7)


def test_hostile_pages_take_linear_time():
    for start in ("<!", "<script ", "<title ", "<?", "</", "<svg <", "<!--", "<![CDATA["):
        began = time.monotonic()
        main_text(start * (1_000_000 // len(start)), {})
        main_text(f"<p>{STORY}</p>" + start * (1_000_000 // len(start)), {})
        assert time.monotonic() - began < 4
    assert main_text(f"<p>{STORY} a <b or <!-- not this", {}) == f"{STORY} a <b or"


def test_deep_pages_take_linear_time():
    for page in ("<div>" * 200_000 + "word", "<div><p>" * 50_000 + "word" + "</span></b>" * 50_000, "<li>word" * 50_000, "<td>" * 100_000 + "</tr>" * 100_000):
        assert set(main_text(page, {}).split()) <= {"word"}


def test_items_end_where_the_next_begins():
    # one-word items cost more than they score, so words on both sides hold them in the region
    page = f"<article><ul><li><p>{STORY}<li>two<ul><li>three</ul><li>four</ul><table><tr><td>a<td>b<tr><th>c</table><p>{STORY}</article>"
    assert main_text(page, {}) == f"{STORY} two three four a b c {STORY}"


def test_odd_rows(spark):
    long_ = prose(random.Random(1), 30_000)
    rows = [(1, "u", None), (2, None, ""), (None, "u", "no tags at all"), (4, "u", "<" * 3000), (5, "u", f"<article><p>{long_}"), (5, "u", "<p"),
            (6, "u", "<a href='" + "x" * 9000), (7, "u", "</p></article><p>" + "</div>" * 50)]
    got = extract_text(spark.createDataFrame(rows, PAGES), {}).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and texts[1] == texts[2] == texts[7] == "" and texts[None] == "no tags at all"
    assert long_ in [r["text"] for r in got]
    empty = spark.createDataFrame([], PAGES)
    assert learn_weights(empty) == {} and extract_text(empty, {}).count() == 0
    clash = extract_text(spark.createDataFrame([(1, "u", "<p>a b c</p>", -1)], PAGES + ", n_chars int"), {})
    assert [tuple(r) for r in clash.collect()] == [(1, "u", "a b c", 5)]


def test_long_attribute_values_end_at_their_quote():
    for n in (10, 3000, 5000, 100_000):
        for quote in "'\"":
            for value in ("k > v " * n, "<b>k</b> " * n):
                page = f"<article><p data-x={quote}{value}{quote} lang=en>story</p><p>{STORY}</p></article>"
                assert main_text(page, {}) == f"story {STORY}"
    # quotes that never end, or end in another tag, take linear time
    for page in ("<a x=\"" * 100_000, "<a x='" + "<a x=\"" * 100_000, "<a " + "\"<a \"" * 100_000, "<a \"'" * 100_000 + "x" * 10_000, "<p '" + "x" * 5000 + "<p \"" * 50_000):
        main_text(page, {})
