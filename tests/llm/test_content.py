"""HTML, TIFF, licenses, toxicity, URLs, quality, and the queries and stages as a whole."""

import hashlib
import html
import html.parser
import os
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op02_html as pages
from quillspark.llm import op03_tiff as tiff
from quillspark.llm import op04_license as license_scan
from quillspark.llm import op06_toxicity as toxicity
from quillspark.llm import op07_urls as urls
from quillspark.llm import op10_quality as quality
from quillspark.llm import queries
from quillspark.llm.common import table

DOCS = "doc_id long, text string, score int, spans string, held_out int, source string"


# -- HTML


def article_of(page):
    """The plain way for the test tables' one template: the article element, a line per block."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    body = re.sub(r"<[a-zA-Z/][^>]*(>|\Z)", lambda g: " " if g[0].startswith(("<b", "</b")) else "\n", m[1])
    return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in body.split("\n")) if x)


def test_test_pages_give_their_articles(spark, sf_dir):
    for r in table(spark, sf_dir, "pages").collect():
        assert pages.main_text(r.html) == article_of(r.html)


LONG = "This is the long text of the page, and it has all that the reader of it would want to know about the thing. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("no tags at all", ""),
        (f"<p>{LONG}</p>", LONG.strip()),
        (f"<nav><a href=x>Home</a></nav><main><h1>T &amp; T</h1><p>Short.</p><p>{LONG}</p></main><footer>&copy; us</footer>", f"T & T\nShort.\n{LONG.strip()}"),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p><aside>not this</aside><form>Name <input></form></article>", f"Title\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></article>", LONG.strip()),
        (f"<div id=cookie-notice><p>{LONG}</p></div><article><p>a<br>b  c</p><script>if (a<b) document.write('</p>')</script></article>", "a b c"),
        (f"<div class=sideBar>{LONG}</div><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p>", f"{LONG.strip()}\nTiny.\n{LONG.strip()}"),
        (f"<p>{LONG}<p><a href=1>one two three four</a> <a href=2>five six seven eight nine ten</a>", LONG.strip()),
        ("<article><p>cut of&am", "cut of&am"),
        ("<article><p>open <a href='x", "open"),
        ("<article><p>1 < 2 &lt; 3 &#x41;&#66; &nbsp; x</p>", "1 < 2 < 3 AB x"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
        ("<article><!-- <p>hidden</p> --><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
        (f"<html><head><title>x</title><style>p {{}}</style><body><p>{LONG}", LONG.strip()),
    ],
)
def test_pages(page, text):
    assert pages.main_text(page) == text


def test_marked_regions_are_evidence_only():
    bad = "Zzz qqq xxx vvv kkk jjj zzz qqq xxx vvv kkk jjj zzz qqq xxx vvv kkk jjj zzz qqq."
    body = LONG.strip()
    assert pages.main_text(f"<div>{LONG}</div><div>{LONG}</div><div class=teasers><article><p>short</p></article></div>").startswith(f"{body}\n{body}")
    assert pages.main_text(f"<div>{LONG}</div><div><article><a href=x>all of it is a link</a></article></div>") == body
    assert pages.main_text(f"<main><p>{bad}</p><p>{LONG}</p><p>{bad}</p></main>") == body
    assert pages.main_text(f"<article><p>{LONG}</p><p>{bad}</p></article>") == f"{body}\n{bad}"
    assert pages.main_text(f"<p>{LONG}</p><article><p>{LONG}</p></article>") == f"{body}\n{body}"
    assert pages.main_text(f"<p>Short words.</p><article><p>{LONG}</p></article><p>{bad}</p>") == body


class PlainBlocks(html.parser.HTMLParser):
    """Blocks of well-formed pages of p, h2, div, a, nav, article: [text, characters in links, out, in an article, heading]."""

    def __init__(self, page):
        super().__init__()
        self.open, self.blocks, self.own = [], [], ["", 0]
        self.feed(page)
        self.cut()

    def cut(self):
        if text := " ".join(self.own[0].split()):
            self.blocks.append([text, self.own[1], "nav" in self.open, "article" in self.open, "h2" in self.open])
        self.own = ["", 0]

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.cut()
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag != "a":
            self.cut()
        self.open.remove(tag)

    def handle_data(self, data):
        self.own[0] += data
        self.own[1] += len("".join(data.split())) * ("a" in self.open)


def two_passes(blocks, stop):
    """The rules as the module states them, by plain loops."""

    def alone(text, links, out, prior):
        if out:
            return "bad"
        if links > (0.7 if prior else 0.2) * len(text) or not prior and links and len(text) < 70:
            return "bad"
        if len(text) < 70:
            return "short"
        found = re.findall(r"[^\W\d_]+", text.lower())
        density = len([w for w in found if w in stop]) / max(1, len(found))
        if density < 0.2:
            return "poor" if prior else "bad"
        return "good" if density >= 0.3 and len(text) > 200 else "near"

    passing = {inside: sum(len(b[0]) for b in blocks if b[3] == inside and alone(b[0], b[1], b[2], False) in ("good", "near")) for inside in (True, False)}
    trusted = any(b[3] and not b[2] for b in blocks) and passing[True] >= passing[False]
    shown = [b for b in blocks if not b[2]]
    first = []
    for b in shown:
        label = alone(b[0], b[1], False, trusted and b[3])
        first.append("bad" if trusted and not b[3] and label == "short" else label)
    kept = []
    for k, b in enumerate(shown):
        decided = ("good", "bad", "near")
        before = next((x for x in reversed(first[:k]) if x in decided), None)
        after = next((x for x in first[k + 1 :] if x in decided), None)
        sides = [x for x in (before, after) if x]
        prior, label = trusted and b[3], first[k]
        if label == "near":
            good = sides != ["bad", "bad"]
        elif label in ("good", "bad"):
            good = label == "good"
        elif not sides:
            good = prior
        elif set(sides) == {"bad"}:
            good = prior and label == "short" and not b[1]
        else:
            good = "bad" not in sides or prior or b[4] and after != "bad"
        if good:
            kept.append(b[0])
    return "\n".join(kept)


def test_pages_by_an_independent_two_pass(monkeypatch):
    """Random pages of blocks, with the stop words and without; density decides outside articles and inside."""
    rng = random.Random(7)
    good, poor = "the cat of a dog in it", "zork blim quax dorn vlim"
    def words(n, p):
        return " ".join(rng.choice((good if rng.random() < p else poor).split()) for _ in range(n))
    made = []
    for _ in range(400):
        page = []
        for _ in range(rng.randint(1, 9)):
            text = words(rng.choice([2, 6, 20, 25, 60]), rng.choice([0, 0.15, 0.35, 0.6, 1]))
            if rng.random() < 0.3:
                text += f" <a href=x>{words(rng.choice([1, 8, 40]), 0.5)}</a>"
            page.append(f"<{(t := rng.choice(['p', 'p', 'div', 'h2', 'nav']))}>{text}</{t}>")
        if rng.random() < 0.6:
            i = rng.randint(0, len(page))
            j = rng.randint(i, len(page))
            page[i:i] = ["<article>"]
            page[j + 1 : j + 1] = ["</article>"]
        made.append("".join(page))
    results = []
    for stop in (pages.STOP_WORDS, frozenset()):
        monkeypatch.setattr(pages, "STOP_WORDS", stop)
        results.append([pages.main_text(p) for p in made])
        assert results[-1] == [two_passes(PlainBlocks(p).blocks, stop) for p in made]
    assert sum(a != b for a, b in zip(*results, strict=True)) > 100


def test_few_stop_words_in_an_article_follow_the_neighbours():
    poor = "Zzz qqq xxx vvv kkk jjj zzz qqq xxx vvv kkk jjj zzz qqq xxx vvv kkk jjj zzz qqq."
    links = f"<p><a href=x>{poor}</a></p>"
    assert pages.main_text(f"<article>{links}<p>{poor}</p>{links}<p>{LONG}</p></article>") == LONG.strip()
    assert pages.main_text(f"<article><p>{LONG}</p><p>{poor}</p>{links}</article>") == f"{LONG.strip()}\n{poor}"


_OUT_IN_LINE = ["<button>Subscribe now</button>", "<label>Name</label>", "<noscript>on</noscript>", "<svg><text>x</text></svg>", "<iframe>i</iframe>", "<object>o</object>", "<span class='ad'>buy</span>", "<span hidden>h</span>", "<i style='display:none'>d</i>", "<b aria-hidden=true>b</b>", "<select><option>a<option>b</select>", "<select><option>a</option></select>", "<em class='site-nav nav'>n</em>"]


@pytest.mark.parametrize("element", _OUT_IN_LINE)
def test_text_out_of_the_article_leaves_its_block_whole(element):
    assert pages.main_text(f"<article><p>{LONG}</p><p>before {element} after it</p></article>") == f"{LONG.strip()}\nbefore after it"


def test_unclosed_select_takes_the_rest_of_its_block():
    assert pages.main_text(f"<article><p>before <select><option>a<option>b</p><p>{LONG}</p></article>") == f"before\n{LONG.strip()}"


@pytest.mark.parametrize("tag", ['p title="Hidden costs"', 'p data-state="hidden"', 'p data-id="comment-5"', "p data-x='class=ad'", 'h2 id="related-work"', 'h2 id="search"', 'section id="search-algorithms"', 'p class="navigate"', 'p id="readers"'])
def test_names_and_values_that_only_look_like_marks_stay(tag):
    assert pages.main_text(f"<article><p>{LONG}</p><{tag}>Some words of the text.</{tag.split()[0]}></article>") == f"{LONG.strip()}\nSome words of the text."
    assert pages.main_text(f"<article><p>{LONG} <a href='/the-hidden-valley?id=search'>link</a> end</p></article>") == f"{LONG.strip()} link end"


@pytest.mark.parametrize("tag", ['div class="sidebar-left"', 'div id="comment-5"', 'div class="x cookieBanner"', "div class=share-buttons", "section class=related-posts", 'div class="ad-300x250"', "div role=search", "div hidden", "p class='newsletter-signup'"])
def test_marked_elements_go(tag):
    assert pages.main_text(f"<article><p>{LONG}</p><{tag}>Some words of the text.</{tag.split()[0]}></article>") == LONG.strip()


def test_deep_nesting_loses_nothing_and_is_linear():
    rest = "The rest of the article follows here."
    for n in (1_950, 100_000):
        page = f"<article><p>{LONG}</p><div><aside>{'<span>' * n}not this</aside></div><p>{rest}</p></article>"
        began = time.time()
        assert pages.main_text(page) == f"{LONG.strip()}\n{rest}"
        assert pages.main_text(f"<article>{'<div>' * n}<p>{LONG}</p>{'</div>' * n}<p>{rest}</p>{'</b></i>' * n}</article>") == f"{LONG.strip()}\n{rest}"
        assert pages.main_text(f"<article>{('<span><p>' + rest) * (n // 50)}<p>{LONG}</article>").count(rest) == n // 50
        assert time.time() - began < 10


def test_pages_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, f"<p>{LONG}</p>" * 3000), (1, "u", ""), (2, "u", None)], "page_id long, url string, html string")
    rows = pages.extract(df).collect()
    assert sorted((r.page_id, r.url or "", r.n_chars) for r in rows) == [(1, "", 3000 * (len(LONG.strip()) + 1) - 1), (1, "u", 0), (2, "u", 0)]
    assert pages.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def test_ambiguous_blocks_follow_their_neighbours():
    bad = "Zzz qqq xxx vvv kkk jjj zzz qqq xxx vvv kkk jjj zzz qqq xxx vvv kkk jjj zzz qqq."
    assert pages.main_text(f"<p>{bad}</p><p>Hm.</p><p>{bad}</p><p>{LONG}</p><p>Yes.</p><p>{LONG}</p>") == f"{LONG.strip()}\nYes.\n{LONG.strip()}"


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "<article>a</article>", "t", 5), (1, "<article>a</article>", "t", 5), (None, None, "t", 5)], "page_id long, html string, text string, n_chars int")
    out = pages.extract(df)
    assert out.columns == ["page_id", "text", "n_chars"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(["(1, 'a', 1)", "(1, 'a', 1)", "(None, '', 0)"])
    assert pages.extract(df.limit(0)).count() == 0


# -- TIFF


@pytest.mark.parametrize("n", [0, 1, 2, 127, 129, 5000, 40_000])
def test_codecs_round_trip(n):
    rng = random.Random(n)
    for data in (os.urandom(n), bytes(rng.choice(b"ab") for _ in range(n)), b"a" * n, (b"the quick brown " * (n // 16 + 1))[:n]):
        assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data


@pytest.mark.parametrize("codec", [tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", "<>")
def test_files_round_trip(codec, order):
    w, h = 37, 29
    for bits in (8, 16, 32, 64):
        for samples in (1, 3):
            data = os.urandom(w * h * samples * bits // 8)
            for layout in ({"rows_per_strip": 7}, {"tile": (16, 16)}, {}):
                for predictor in (1, 2, 3)[: 2 + (bits > 8)]:
                    page = {"width": w, "height": h, "samples": samples, "bits": bits, "data": data, "codec": codec, "predictor": predictor} | layout
                    got = list(tiff.read_tiff(tiff.write_tiff([page, page], order)))
                    assert [p["data"] for p in got] == [data, data]


def test_lzw_codes_are_those_of_the_format():
    """The example of the format's description: 7 7 7 8 8 7 7 6 6."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    coded = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(data) == coded and tiff.lzw_decode(coded, 9) == data


def test_float_prediction_by_hand():
    """Two pixels 1.0 and 2.0 of 32 bits: bytes 3f 40, 80 00, 00 00, 00 00, as differences."""
    plain = bytes([0x3F, 0x40, 0x80, 0, 0, 0, 0, 0])
    coded = bytes([plain[0], *((b - a) & 255 for a, b in zip(plain, plain[1:]))])
    page = {"width": 2, "height": 1, "bits": 32, "data": np.array([1, 2], "<f4").tobytes(), "predictor": 3}
    made = tiff.write_tiff([page])
    assert coded in made and next(tiff.read_tiff(made))["data"] == page["data"]


def test_samples_of_four_bits_and_none():
    page = {"width": 3, "height": 2, "samples": 1, "bits": 8, "data": b"\x12\x30\x45\x60\0\0"}
    made = bytearray(tiff.write_tiff([page]))
    at = int.from_bytes(made[4:8], "little")
    for k in range(int.from_bytes(made[at : at + 2], "little")):
        entry = at + 2 + 12 * k
        if int.from_bytes(made[entry : entry + 2], "little") == tiff.BITS:
            made[entry + 8] = 4
            assert next(tiff.read_tiff(bytes(made)))["data"] == b"\x12\x30\x45\x60"
            made[entry + 8] = 8
        if int.from_bytes(made[entry : entry + 2], "little") == tiff.SAMPLES:
            odd = made.copy()
            odd[entry + 8] = 0
            assert "samples" in next(tiff.read_tiff(bytes(odd)))["error"]


def test_pages_beside_clashing_names_and_no_rows(spark):
    good = tiff.write_tiff([{"width": 4, "height": 2, "data": b"12345678", "codec": tiff.LZW}])
    files = spark.createDataFrame([(1, good, "x")], "Page long, media binary, data string")
    rows = tiff.tiff_pages(files, "Page")
    assert rows.columns[:2] == ["Page", "_page"] and [(r.Page, r._page, bytes(r.data)) for r in rows.collect()] == [(1, 0, b"12345678")]
    assert tiff.tiff_pages(files.limit(0), "Page").count() == 0
    docs = spark.createDataFrame([(1, "é" * 1_500_000, 5)], "doc_id long, text string, feature int")
    r = tiff.text_media(docs).first()
    assert r.n_bytes == 3_000_000 and r.feature.startswith("pages=3;") and tiff.text_media(docs.limit(0)).count() == 0


def test_each_codec_meets_all_sizes(spark, sf_dir):
    rows = tiff.op3_tiff(spark, sf_dir).collect()
    for codec in ("lzw", "packbits", "deflate"):
        sizes = [r.n_bytes for r in rows if f"codecs={codec};" in r.feature]
        assert len(sizes) > 0.2 * len(rows) and min(sizes) < 1000 < max(sizes)


def test_broken_files_say_so(spark):
    good = tiff.write_tiff([{"width": 4, "height": 2, "data": b"12345678", "codec": tiff.DEFLATE}] * 2)
    loop = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = good[4:8]
    files = [(1, good), (2, bytes(loop)), (3, b"junk"), (4, None), (5, good[:20]), (1, good)]
    rows = tiff.tiff_pages(spark.createDataFrame(files, "file long, media binary"), "file").collect()
    found = {k: [(r.page, bytes(r.data) if r.data else None, r.error) for r in rows if r.file == k] for k in range(1, 6)}
    assert len(found[1]) == 4 and all(x[1] == b"12345678" for x in found[1])
    assert [x[1] for x in found[2]] == [b"12345678", None] and "loop" in found[2][1][2]
    assert all(len(found[k]) == 1 and found[k][0][2] for k in (3, 4, 5))


def test_media_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "x" * 70)], "doc_id long, text string"))
    rows = tiff.text_media(odd, keep_media=True).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        data = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        back = b"".join(p["data"] for p in tiff.read_tiff(bytes(r.media)))
        assert back == data and (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(data), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()


# -- licenses


def test_inheritance_and_ties(spark):
    rows = [
        (1, "r", "LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "r", "a/b/x", "nothing"),
        (3, "r", "a/LICENSE", "Released under the MIT License."),
        (8, "r", "a/COPYING.txt", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        (4, "r", "a/b/c/y", None),
        (5, "other", "z", "nothing"),
        (6, None, None, ""),
        (6, None, None, ""),
        (7, "r", "a/own", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
    ]
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license string, notice string")
    df = spark.createDataFrame(rows, "file long, repo string, path string, text string").withColumn("license", F.lit("clash"))
    out = license_scan.scan(df, templates, "file", "repo", "path", "text").collect()
    got = sorted((r.id, r.license, r.origin, r.origin_dir) for r in out if r.id != 6)
    # The directory a has two licenses; the better score, then the first name, speaks for it.
    best = max((r.score, r.license) for r in out if r.id in (3, 8))
    assert got[0] == (1, "Apache-2.0", "own", "") and got[2] == (3, "MIT", "own", "a") and got[-2:] == [(7, "GPL-3.0", "own", "a"), (8, "GPL-3.0", "own", "a")]
    assert all(x[2:] == ("inherited", "a") for x in got if x[0] in (2, 4)) and best[0] > 0.9
    assert got[4] == (5, None, "none", None)
    assert sum(r.id == 6 and r.origin == "none" for r in out) == 2
    assert license_scan.scan(df.limit(0), templates, "file", "repo", "path", "text").count() == 0


def test_wrapped_headers_licence_files_and_long_lines(spark):
    bsd = next(n for name, n in license_scan.TEMPLATES if name == "BSD-3-Clause" and "Neither" in n)
    mit = next(n for name, n in license_scan.TEMPLATES if name == "MIT" and "NONINFRINGEMENT" in n)
    wrap = lambda text, n, mark: "\n".join(mark + line for line in textwrap.wrap(text, n))
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    rows = [
        (1, "r", "a.c", "/* " + wrap(mpl, 70, " * ").lstrip(" *") + " */\nint main;\n" + "x " * 300),
        (2, "r", "lib/LICENSE.txt", "Copyright (c) 2001\n\n" + bsd.replace(". 1.", ".\n\n1.").replace(" 3. ", "\n\n3. ").replace(" THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS")),
        (3, "r", "b.py", wrap(gpl, 75, "# ") + "\n\ncode = 1"),
        (4, "r", "lib/c/d.js", "no license in sight"),
        (5, "r", "e.js", "word\n\n" + wrap(mit, 60, "") + "\n\nmore words"),
        (6, "r", "f.js", "Released under the MIT License. " * 100),
        (7, "r", "lib/g/COPYING", None),
        (8, "r", "lib/h/own.py", "# Released under the MIT License."),
        (9, "r", "lib/h/other.py", "nothing"),
    ]
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license string, notice string")
    df = spark.createDataFrame(rows, "file long, repo string, path string, text string")
    got = {r.id: (r.license, r.origin, r.origin_dir) for r in license_scan.scan(df, templates, "file", "repo", "path", "text").collect()}
    assert got == {
        1: ("MPL-2.0", "own", ""),
        2: ("BSD-3-Clause", "own", "lib"),
        3: ("GPL-3.0", "own", ""),
        4: ("BSD-3-Clause", "inherited", "lib"),
        5: ("MIT", "own", ""),
        6: ("MIT", "own", ""),
        7: ("BSD-3-Clause", "inherited", "lib"),
        8: ("MIT", "own", "lib/h"),
        9: ("BSD-3-Clause", "inherited", "lib"),  # a file with a notice doesn't speak for its directory
    }
    assert {r.origin for r in license_scan.scan(df, templates.limit(0), "file", "repo", "path", "text").collect()} == {"none"}


# -- URLs


def plain_verdict(url):
    url = url or ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), v == "block", h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    won = max(fits, default=None)
    return host, path, won and won[2], ("block" if won[1] else "allow") if won else "allow"


def test_urls_by_rule(spark):
    cases = [None, "", "no scheme", "http://COM/en/", "http://a.example.com/en/7x?y", "http://example.com/en/8", "x://notexample.com/en/7", "http://b.net/de/", "http://example.net/de/8#f", "http://org/es/", "http://a.org?/es/", "http://a.org#x/es/", "http://h.com:80/en/", "http://../en/", "a://b://c.com/en/", "HTTP://EXAMPLE.COM/EN/7", "http://com/en/" + "z" * 5000, "http://É.com/en/\n"]
    rng = random.Random(1)
    cases += ["http://" + rng.choice(["a.", "", "x.y."]) + rng.choice(["example.", ""]) + rng.choice(["com", "net", "org"]) + "/" + rng.choice(["en", "de", "es"]) + "/" + rng.choice("6789") for _ in range(100)]
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate(cases)] + [(3, cases[3], 1)], "page_id long, url string, verdict int")
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    rows = urls.filter_urls(df, rules).collect()
    assert len(rows) == len(cases) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == plain_verdict(cases[r.page_id]) for r in rows)
    assert urls.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, rules.limit(0), default="block").collect()} == {"block"}


def test_large_lists_odd_rules_and_pages_without_hosts(spark, monkeypatch):
    """The ways beyond the broadcast bounds, a rule for the empty host, many pages without one, very long URLs."""
    cases = [None] * 50 + ["none"] * 50 + ["http://a.com/en/", "http://org/es/x", "http://x.y/" + "p/" * 50_000]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)], "page_id long, Host string, host_key string")
    rules = spark.createDataFrame([*urls.RULES, ("block", None, ""), ("allow", "com", "/en/"), ("block", "y", "/p/p/")], "verdict string, host string, path string")
    want = {**{k: ("", "block") for k in range(100)}, 100: ("com/en/", "block"), 101: ("org/es/", "block"), 102: ("y/p/p/", "block")}
    for blocks, size in ((urls.BROADCAST_BLOCKS, urls.BROADCAST_BYTES), (0, 0)):
        monkeypatch.setattr(urls, "BROADCAST_BLOCKS", blocks)
        monkeypatch.setattr(urls, "BROADCAST_BYTES", size)
        out = urls.filter_urls(df, rules, "Host")
        assert out.columns == ["page_id", "host_key", "host", "path", "rule", "verdict"]
        assert {r.page_id: (r.rule, r.verdict) for r in out.collect()} == want


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bloom = urls.blocked_bloom(keys, 3000 // urls.KEYS_PER_BLOCK)
    tested = spark.range(6000).select("id", F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    passed = tested.select("id", "key", urls._block("key", 3000 // urls.KEYS_PER_BLOCK)).join(bloom, "block")
    for k, bit in enumerate(urls._bit_columns("key")):
        passed = passed.filter(F.col(f"w{k}").bitwiseAND(bit) != 0)
    ids = {r.id for r in passed.select("id").collect()}
    assert set(range(3000)) <= ids and len(ids) < 3200


# -- classifiers


def labelled(seed, n=400):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic, poor = int(rng.random() < 0.3), int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "vilething", "vilest"])
        text = " ".join(w.upper() + "!!" if poor else w for w in words)
        rows.append((k, text, 1 - poor, toxic))
    return rows


def test_crf_finds_planted_words():
    crf = toxicity.fit([(t, x) for _, t, _, x in labelled(1)], 0.3)
    for _, text, _, toxic in labelled(2):
        own = toxicity.words(text)
        score, places, p = crf.score(own)
        assert (score >= toxicity.THRESHOLD) == bool(toxic) and 0 <= score <= 1
        assert all(own[k].startswith(b"vile") for k, x in zip(places, p, strict=True) if x >= 0.5)


def test_marginals_equal_full_forward_backward():
    rng = np.random.default_rng(4)
    crf = toxicity.Crf({b"bad": 2.0, b"odd": -1.0, b"worse": 0.7}, -1.3, rng.normal(size=(2, 2)), rng.normal(size=2))
    gaps = [[b"bad", *[b"x"] * n, b"odd"] for n in (255, 256, 257, 894, 5000, 100_000)]
    for own in [*([[b"bad", b"odd", b"worse", b"x", b"y"][k] for k in rng.integers(0, 5, rng.integers(1, 40))] for _ in range(30)), *gaps]:
        crf.move[:] = [[0, -9], [-9, 0]] if len(own) > 200 else crf.move  # states that last
        crf.prepare()
        emit = np.array([[1.0, np.exp(crf.bias + sum(crf.weights.get(f, 0) for f in toxicity.word_features(w)))] for w in own])
        move, n = np.exp(crf.move), len(own)
        f, b = np.zeros((n, 2)), np.ones((n, 2))
        f[0] = np.exp(crf.start) * emit[0]
        for i in range(1, n):
            f[i] = (f[i - 1] @ move) * emit[i]
            f[i] /= f[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = move @ (emit[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        full = (f * b)[:, 1] / (f * b).sum(axis=1)
        places, values = crf.evidence(own)
        assert np.allclose(crf.marginals(n, places, values), full[places])


def test_attention_model_learns_and_its_gradient_is_right():
    model = quality.fit([(t, q) for _, t, q, _ in labelled(1)], 0.7, steps=200)
    rows = labelled(2)
    scores = model.score(*quality.encode([t for _, t, _, _ in rows]))
    assert np.mean((scores >= quality.THRESHOLD) == np.array([q == 1 for _, _, q, _ in rows])) > 0.98
    odd = model.score(*quality.encode(["", None, "a", " \n ", "é" * 10_000, "word " * 50_000]))
    assert odd.shape == (6,) and ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1] == odd[3]
    rng = np.random.default_rng(0)
    x, mask, y = rng.normal(size=(5, 3, quality.FEATURES)), np.ones((5, 3), bool), np.array([0.0, 1, 1, 0, 1])
    mask[1, 2] = False

    def loss():
        p = model.p
        h = np.tanh(x @ p["W"] + p["b"])
        e = np.where(mask, (np.tanh(h @ p["V"]) * quality._sigmoid(h @ p["U"])) @ p["w"], -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        s = quality._sigmoid((a[:, :, None] * h).sum(axis=1) @ p["c"] + p["d"])
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = model.step(x[mask], mask.sum(axis=1), y, np.ones(5))
    for name, grad in grads.items():
        k = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        model.p[name] = model.p[name].copy()
        kept, eps = model.p[name][k], 1e-5
        model.p[name][k] = kept + eps
        up = loss()
        model.p[name][k] = kept - eps
        down = loss()
        model.p[name][k] = kept
        assert abs((up - down) / (2 * eps) - grad[k]) < 1e-4 * max(1, abs(grad[k]))


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, module, label):
    rows = labelled(1, 120)
    docs = spark.createDataFrame([(k, t, 1, "s", 2, "x") for k, t, _, _ in rows] + [(None, "a b", 1, "s", 2, "x"), (7, None, 1, "s", 2, "x"), (7, "", 1, "s", 2, "x")], DOCS)
    labels = spark.createDataFrame([(k, q, x) for k, _, q, x in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels)
    scored = module.score_texts(docs, model)
    assert scored.count() == docs.count() and all(0 <= r.score <= 1 for r in scored.select(F.col("score").alias("score")).collect())
    kept = module.drop_toxic(docs, labels) if label == "toxic" else module.drop_poor(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    drop = module.drop_toxic if label == "toxic" else module.drop_poor
    odd = docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text", F.lit(42).alias("score"), F.lit("s").alias("Spans"), F.col("doc_id").alias("rid"), F.lit(1).alias("cell"))
    named = labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    some = drop(odd, named)
    assert some.schema == odd.schema and some.exceptAll(odd).isEmpty() and 0 < some.count() < odd.count()
    assert drop(odd, labels).schema == odd.schema  # other ids: no labels fit
    none = labels.limit(0)
    assert (module.drop_toxic(docs, none) if label == "toxic" else module.drop_poor(docs, none)).count() == docs.count()
    assert module.score_texts(docs.limit(0), model).count() == 0


def test_held_out_rows_are_not_learnt(spark):
    """Labels of held-out rows can be anything."""
    rows = labelled(1, 200)
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows], "doc_id long, text string")
    flip = lambda k, x: 1 - x if zlib.crc32(str(k).encode()) % 4 == 2 else x
    a = toxicity.train(docs, spark.createDataFrame([(k, x) for k, _, _, x in rows], "doc_id long, toxic int"))
    b = toxicity.train(docs, spark.createDataFrame([(k, flip(k, x)) for k, _, _, x in rows], "doc_id long, toxic int"))
    assert a.weights == b.weights and a.bias == b.bias


# -- all queries, SQL where there is some, and the pipeline


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_every_operator_is_registered():
    found = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= before, name
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in docs.collect()}


def similar_roots(texts):
    """The first row of each component of texts with five-word Jaccard similarity of 0.8 or more, by all pairs."""
    sets = []
    for text in texts:
        own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted(set(root))


def test_pipeline_is_brute_force_on_odd_rows(spark, tmp_path):
    """Null and repeated texts, near copies, benchmark passages, extra columns with clashing names: stage by stage against plain loops."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng, rows = random.Random(3), [(k, t) for k, t, _, _ in labelled(5, 160)]
    passage = "seven brave foxes walk over the quiet green hill at noon today"
    for k in range(20):
        words = rows[k][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words)))  # near copies, and their sources too if one word is little
        rows.append((2000 + k, rows[20 + k][1]))
    rows += [(3000, rows[50][1] + " " + passage.upper()), (3001, None), (3002, ""), (3003, rows[51][1] + "\n" * 50_000)]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or ""), k, "x", 1.0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int, id long, node string, score double")
    labels = spark.createDataFrame([(k, q, x) for k, _, q, x in labelled(5, 160)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, passage)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    stages, own = dict(corpus_pipeline.STAGES), dict(rows)

    def after(name, df):
        out = stages[name](spark, df, str(tmp_path))
        assert out.columns == docs.columns
        return spark.createDataFrame(out.collect(), docs.schema)

    crf = toxicity.train(docs, labels)
    clean = after("toxicity", docs)
    want = [k for k, t in rows if crf.score(toxicity.words(t))[0] < toxicity.THRESHOLD]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(want) and 0 < len(want) < len(rows)
    model = quality.train(clean, labels)
    good = after("quality", clean)
    want = [k for k in want if model.score(*quality.encode([own[k]]))[0] >= quality.THRESHOLD]
    assert sorted(r.doc_id for r in good.collect()) == sorted(want)
    single = after("near-duplicates", good)
    ids = sorted(want)
    want = [ids[k] for k in similar_roots([own[k] for k in ids])]
    assert sorted(r.doc_id for r in single.collect()) == want and len(want) < len(ids)
    plain = after("decontamination", single)
    fold = lambda t: " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()))
    windows = [" ".join(passage.split()[i : i + 10]) for i in range(3)]
    want = [k for k in want if not any(f" {w} " in f" {fold(own[k])} " for w in windows)]
    assert sorted(r.doc_id for r in plain.collect()) == want
    assert {r.doc_id for r in stages["packing"](spark, plain, str(tmp_path)).collect()} == set(want)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(want)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
