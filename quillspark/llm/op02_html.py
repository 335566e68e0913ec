"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Pass one decides each block by
itself from its length, the share of its characters in links and the share of
stop words among its words. Text in menus, headers, footers, sidebars, notices,
adverts, forms and comments is out by its markup, and no part of a block: an element
within a line that is out leaves its block whole. Short blocks stay open.
Pass two gives an open block the label of its nearest decided neighbours.
All blocks go through both passes. An article or main element is evidence only, and
only if it holds at least half of the text that passes by itself: inside, more links are
allowed, and a long block of an article with few stop words stays open, to follow its
neighbours; outside, short blocks are out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import spread, tidy
from .common import table

SHORT, LONG = 70, 200
LINKS, ARTICLE_LINKS = 0.2, 0.7
STOP_LOW, STOP_HIGH = 0.2, 0.3
#: Which marked region a block is in; 0 is none.
MAIN, ARTICLE = 1, 2

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our even most me also"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein"
    " le la les de des du et en un une que qui dans pour pas au sur plus ne par avec se ce il elle est sont mais comme ou son sa ses aux cette été être leur nous vous"
    " el los las del y que en se por con una su para es al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
OUT_TAGS = frozenset("nav footer aside form button select option datalist noscript template iframe svg canvas object embed audio video map dialog menu math head label input".split())
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that only their own end tag, or that of one around them, closes.
_WALLS = frozenset(("article", "main", "body", "table"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class and id names whose elements are out; those of the second set only outside an article.
OUT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
OUTER_NAMES = frozenset("header top bottom copyright meta tags".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?/][^>]*>?|<[a-zA-Z][^>]*\Z""", re.S)
#: Whole attributes one after the other, so that nothing is found within the value of another one.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Parts of names that say where or in what an element stands, not what it is.
_FRAMES = frozenset("area articles bar block body bottom box btn button buttons col column container content heading icon icons inner item items left link links list main outer panel posts right row section slot stories text title top unit wrap wrapper".split())
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW_TAGS}


class Block:
    __slots__ = ("text", "links", "article", "heading", "label")

    def __init__(self, text: str, links: int, article: int, heading: bool):
        self.text, self.links, self.article, self.heading, self.label = text, links, article, heading, ""


def _kinds(value: str) -> set[str]:
    """What the names of a class or id attribute say: each as a whole, and its last part that isn't a frame; parts are marked by other characters than letters, or by capitals."""
    found = set()
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        while len(parts) > 1 and (parts[-1] in _FRAMES or len(parts[-1]) == 1):
            parts.pop()
        found |= {name.lower(), *parts[-1:]}
    return found


def _out_by_markup(tag: str, attributes: str, article: bool) -> bool:
    if tag in OUT_TAGS or tag == "header" and not article:
        return True
    if not attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in OUT_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main", *_HEADINGS):
            kinds = _kinds(value)
            if tag == "article":
                if kinds & {"comment", "comments", "related", "promo", "ad", "teaser"}:
                    return True
            elif kinds & OUT_NAMES or not article and kinds & OUTER_NAMES:
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order; their text is decoded and its white space made single."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, out, in a marked region
    # Where in the stack each tag, any block and any element that end tags of others don't reach beyond is open.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    walls: list[int] = []
    runs: list[str] = []
    links = 0
    out, article = False, 0

    def close_block() -> None:
        nonlocal runs, links
        if runs:
            if text := " ".join("".join(runs).split()):
                found.append(Block(text, links, article, any(places.get(t) for t in _HEADINGS)))
            runs, links = [], 0

    def push(tag: str, now: bool, inside: int) -> None:
        nonlocal out, article
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            blocks.append(len(stack))
        if tag in _WALLS:
            walls.append(len(stack))
        stack.append((tag, now, inside))
        out, article = now, inside

    def pop_to(k: int) -> None:
        nonlocal out, article
        for tag, _, _ in reversed(stack[k:]):
            places[tag].pop()
        for marks in (blocks, walls):
            while marks and marks[-1] >= k:
                marks.pop()
        del stack[k:]
        out, article = stack[-1][1:] if stack else (False, 0)

    def put(text: str) -> None:
        nonlocal links
        if text and not out:
            text = html.unescape(text) if "&" in text else text
            runs.append(text)
            if places.get("a"):
                links += len("".join(text.split()))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[7]:
                put(m[7])
            continue
        if m[1] or m[4]:  # an end tag
            own = places.get(tag)
            at_end = own and (tag in ("article", "main", "body", "html") or not walls or own[-1] >= walls[-1])
            # What ends within an element that is out doesn't cut the block around it.
            if tag in BLOCK_TAGS and not (stack[own[-1] - 1][1] if at_end and own[-1] else out and not at_end):
                close_block()
            if at_end:
                pop_to(own[-1])
            continue
        if tag in RAW_TAGS:
            close = _CLOSE[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            runs.append(" ")
            continue
        if tag in BLOCK_TAGS:
            if not out:
                close_block()
            if stack and stack[-1][0] == "head":  # its end tag may be left out
                pop_to(len(stack) - 1)
            # A block ends an open paragraph, an item an open item.
            ends = ("p",) if tag not in ("li", "dt", "dd", "tr", "td", "th", "option") else {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}[tag]
            if blocks and stack[blocks[-1]][0] in ends:
                pop_to(blocks[-1])
        if tag in VOID_TAGS or (m[3] or m[6] or "").endswith("/") and tag not in BLOCK_TAGS:
            continue
        inside = ARTICLE if tag == "article" else article or MAIN * (tag == "main")
        now = out or _out_by_markup(tag, m[3] or m[6] or "", inside)
        push(tag, now, inside)
    close_block()
    return found


_WORDS = re.compile(r"[^\W\d_]+")


def first_pass(block: Block, prior: bool = False) -> str:
    """good, bad, near (probably good), short or poor (both open; few stop words); prior: the block lies in a region that speaks for it."""
    n = len(block.text)
    share = block.links / max(1, n)
    if share > (ARTICLE_LINKS if prior else LINKS):
        return "bad"
    if not prior and ("\xa9" in block.text or block.links and n < SHORT):
        return "bad"
    if n < SHORT:
        return "short"
    words = _WORDS.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= STOP_HIGH:
        return "good" if n > LONG else "near"
    return "near" if density >= STOP_LOW else "poor" if prior and block.article == ARTICLE else "bad"


def _trusted(blocks: list[Block]) -> bool:
    """Whether the marked regions speak for their blocks: they hold at least half of the text that passes by itself."""
    inside = outside = 0
    for b in blocks:
        if first_pass(b) in ("good", "near"):
            inside, outside = inside + len(b.text) * bool(b.article), outside + len(b.text) * (not b.article)
    return inside >= outside


def classify(blocks: list[Block]) -> list[Block]:
    """Both passes; returns the good blocks."""
    marked = any(b.article for b in blocks) and _trusted(blocks)
    for b in blocks:
        b.label = first_pass(b, marked and bool(b.article))
        if marked and not b.article and b.label == "short":
            b.label = "bad"  # beside a trusted region a block must pass by its own text
    decided: list[str] = [b.label for b in blocks]
    before, last = [], ""
    for x in decided:
        before.append(last)
        last = x if x in ("good", "bad", "near") else last
    after, last = [""] * len(blocks), ""
    for k in range(len(blocks) - 1, -1, -1):
        after[k] = last
        last = decided[k] if decided[k] in ("good", "bad", "near") else last
    for b, x, y in zip(blocks, before, after, strict=True):
        sides, prior = [s for s in (x, y) if s], marked and bool(b.article)
        if b.label in ("short", "poor"):
            if not sides:
                b.label = "good" if prior else "bad"
            elif all(s == "bad" for s in sides):
                b.label = "good" if prior and b.label == "short" and b.links == 0 else "bad"
            elif "bad" not in sides or prior or b.heading and y != "bad":
                b.label = "good"
            else:
                b.label = "bad"
        elif b.label == "near":
            b.label = "bad" if len(sides) == 2 and all(s == "bad" for s in sides) else "good"
    return [b for b in blocks if b.label == "good"]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks_of(page or "")))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages without html_col, with text_col (empty if a page has no main text, or is null) and n_chars.

    Rows stay as they are, repeated ones too; columns named like the new ones
    give way to them. Pages of any length are read whole; an empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower(), "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [main_text(p) for p in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, text_col, "n_chars"])

    slim = pages.select(*kept, html_col)
    schema = slim.drop(html_col).schema.add(text_col, "string").add("n_chars", "long")
    return spread(slim).mapInArrow(tidy(run), schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", F.col("url"), "html")).select("page_id", "url", "text", "n_chars")


#: The test tables' pages have one article each, of headings and paragraphs; its blocks are taken by patterns here, without any rule of the operator.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, row_number() OVER () AS r, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|\z)', 1) AS body FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(body, '</?br?>', ' ', 'g'), '<[a-zA-Z/][^>]*(>|\z)', chr(10), 'g') AS plain FROM a),
c AS (SELECT *, replace(replace(replace(replace(replace(plain, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&') AS decoded FROM b),
l AS (SELECT *, list_filter(list_transform(string_split(decoded, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{A0}]+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines FROM c)
SELECT page_id, url, array_to_string(lines, chr(10)) AS text, CAST(length(array_to_string(lines, chr(10))) AS BIGINT) AS n_chars FROM l
"""
