"""Chat formatting, WARC, HTML and the quality classifier: round trips, brute force, held-out accuracy."""

import base64
import collections
import hashlib
import itertools
import os
import random
import subprocess
import sys
import time
import zlib

import pytest

from wayleave.llm import chat, warc
from wayleave.llm.html_text import BUCKETS, _bucket, extract, learned, main_text, minimum_cut
from wayleave.llm.quality import good_documents, quality_scores

SF = "/root/testdata/sf0.01"


def test_chat(spark):
    turns = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, None, None), (1, 0, "as\\sis\ntant", "<|im_end|>\n<|im_start|>x\\"), (2, 5, "assistant", "é😀<|im_<|im_end|>end|>\\\\"), (2, None, "assistant", "last\n")]
    turns += [(None, 1, "user", "x"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 1, "assistant", "long " * 50_000)]
    turns += [(9, i, "assistant" if i % 2 else "user", f"t{i} <s>") for i in range(9000)]
    df = spark.createDataFrame([(c, t, r, x, "more") for c, t, r, x in turns], "conv_id long, turn long, role string, text string, chunk string")
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append(((t is None, t or 0), r or "", x or ""))
    rows = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert len(rows) == len(by)
    for c, said in by.items():
        said.sort()
        text = "".join(f"{r}\n{x}\n" for _, r, x in said)
        loss = "".join(x for _, r, x in said if r == "assistant")
        r = rows[c]
        assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert rows[9].n_chunks > 1
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/", "<b>x</b>"), (2, "http://b/?q=%20", "<b>x</b>"), (3, "u\r\nx yé", None), (4, None, ""), (5, "z", "éß" * 90_000), (None, "n", "<b>x</b>"), (6, "http://a/", "\r\n\r\nWARC/1.1\r\n"), (7, "k", "only")]
    df = spark.createDataFrame([(i, u, h, "d") for i, u, h in pages], "page_id long, url string, html string, d string")
    rows = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(rows) == len(pages)
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    for i, u, h in pages:
        payload = (h or "").encode()
        r = rows[i]
        first = last[h or ""] == i
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to, r.url) == (("response", None) if first else ("revisit", last[h or ""])) + (u or "",)
        assert r.payload == ((h or "") if first else None)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_members_and_index(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}") for i in range(600)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}"
    archives = warc.write(df, folder).collect()
    index = warc.normalise(spark.createDataFrame(archives), folder).collect()
    assert sum(r.n for r in index) == 600
    for r in index:
        data = open(r.path, "rb").read()
        assert len(list(warc.members(data[r.offset : r.offset + r.length]))) == r.n
    lines = open(index[0].path + ".idx").read().split("\n")[:-1]
    at, size = map(int, lines[17].split(" ")[:2])
    assert b"<urn:page:" in zlib.decompress(data[at : at + size], 31)


def test_html():
    page = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div>
    <article><h1>Head &amp; line</h1><p><b>First  text<br>more<p>Second &lt;one&gt;</p><div class="newsletter-signup">Sign up</div><p>x</p></article>
    <aside>side</aside><div id="comments"><p>nice</p></div><form>f<input></form><footer>&copy; foot</footer>"""
    assert main_text(page) == "Head & line\n\nFirst text more\n\nSecond <one>\n\nx"
    assert main_text("<div class='layout with-sidebar'><article>kept</article></div><div class='sidebar'>gone</div>") == "kept"
    assert main_text("") == "" and main_text("<!-- open") == "" and main_text("<p") == ""
    assert main_text("<main>5 < 6 and &nosuch; &#x41;</main>") == "5 < 6 and &nosuch; A"


def test_html_attributes_and_inline_pieces():
    long = "many words of the article stand here " * 8
    page = "<article><p>%s</p></article>"
    for a in ('href="/hidden-gems"', 'href="/p?id=footer"', 'style="overflow:hidden"', 'data-hidden="false"', 'data-id="menu"', 'title="a hidden id=nav"', "data-x=hidden", "href=/a/hidden"):
        assert main_text(page % f"<a {a}>x</a> {long}") == f"x {long}".strip(), a
        assert main_text(f"<article><div {a}><p>{long}</p></div></article>") == long.strip(), a
    for a in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "class=x hidden"):
        assert main_text(page % f"<span {a}>secret</span>{long}") == long.strip(), a
        assert main_text(page % f"{long}<div {a}>secret</div>") == long.strip(), a
        assert main_text(f"<article>{long}<span {a}>secret<div>more</div></span></article>") == long.strip(), a
    assert main_text(page % f"<svg><text>icon</text></svg>{long}") == long.strip()
    assert main_text(page % f"<button>Press</button> {long}") == f"Press {long}".strip()
    assert main_text(page % long + "<div><button>Press</button></div>") == long.strip()


def test_html_names_are_finite():
    long = ("many words of the article stand here " * 8).strip()
    body = f"<h1>A heading of the page with words enough</h1><p>{long}</p><p>{long}</p>"
    want = f"A heading of the page with words enough\n\n{long}\n\n{long}"
    for name in ("page-with-sidebar", "post comments-open", "layout--has-sidebar", "entry-content legal-news", "sidebar"):
        for page in ('<main class="%s">%s</main>', '<div id="%s"><article>%s</article></div>', '<div class="%s">%s</div>'):
            assert main_text(page % (name, body)) == want, (name, page)
        assert main_text(f'<nav>Menu</nav><article class="{name}">{body}</article><div class="sidebar">gone</div><footer>gone</footer>') == want, name
    for name in ("sidebar", "comments", "post-comments", "share-buttons", "related-posts", "side-bar", "newsletter_signup"):
        assert main_text(f'<main><article>{body}<div class="{name}"><p>gone with the furniture</p></div></article></main>') == want, name
        assert main_text(f'<article>{body}</article><div id="{name}"><p>gone with the furniture</p></div>') == want, name


def test_html_short_text_is_kept():
    long = ("many words of the article stand here " * 8).strip()
    assert main_text(f"<body><h1>Title</h1><p>{long}</p></body>") == f"Title\n\n{long}"
    assert main_text(f"<body><p>First.</p><p>{long}</p><h2><a href=/x>Linked</a></h2><p>{long}</p><p>The end.</p></body>") == f"First.\n\n{long}\n\nLinked\n\n{long}\n\nThe end."
    assert main_text("<body><p>One short line.</p><p>Two of <a href=/y>them</a> here.</p><ul><li>a</li><li>b</li></ul></body>") == "One short line.\n\nTwo of them here.\n\na\n\nb"
    assert main_text(f"<body><ul><li><a href=/>Home</a></li><li><a href=/b>News of today</a></li></ul><p>{long}</p></body>") == long


def test_html_furniture_names_and_forms_inside_content():
    long = ("many words of the article stand here " * 12).strip()
    assert main_text(f"<body><form id=aspnetForm><div class=content><h1>Title here</h1><p>{long}</p></div></form></body>") == f"Title here\n\n{long}"
    for name in ("legal", "notice-period", "share-price", "search-results-explained"):
        assert main_text(f"<article><p>{long}</p><div class='{name}'><p>{long}</p></div></article>") == f"{long}\n\n{long}", name
    for small in ("<form><p>Your mail</p></form>", "<nav>Home</nav>", "<footer><p>All rights</p></footer>", "<aside>Other</aside>"):
        assert main_text(f"<article><p>{long}</p>{small}</article>") == long, small
        assert main_text(f"<body>{small}<div><p>{long}</p></div></body>") == long, small


NAMED = ["sidebar", "advert", "comments", "newsletter", "sponsored", "share", "related", "cookie-consent", "menu", "pagination"]


@pytest.mark.parametrize("words", [20, 100, 500])
@pytest.mark.parametrize("name", NAMED)
def test_html_long_furniture(name, words):
    """However long, in one block or many, within an article, a main element or beside the text."""
    rng = random.Random(words)
    say = lambda n: " ".join(rng.choice(["wind", "over", "the", "grey", "roofs", "and", "no", "rain"]) for _ in range(n)) + "."
    many = "".join(f"<p>{say(max(1, words // 5))}</p>" for _ in range(5))
    text = [say(30), say(60), say(25)]
    for held in (f"<p>{say(words)}</p>", many, f"<div class=content><article>{many}</article></div>"):
        for mark in (f"<div class={name}>%s</div>", f"<section id={name}>%s</section>", f"<ol class='{name}'><li>%s</li></ol>"):
            bar = mark % held
            for page in (f"<article><h1>Title</h1><p>{text[0]}</p>{bar}<p>{text[1]}</p><p>{text[2]}</p></article>", f"<main><h1>Title</h1><p>{text[0]}</p><p>{text[1]}</p>{bar}<p>{text[2]}</p></main>", f"<body><h1>Title</h1><p>{text[0]}</p><p>{text[1]}</p><p>{text[2]}</p>{bar}</body>"):
                if len(bar) < 5 * sum(map(len, text)):  # what holds nearly all of a page is its text
                    assert main_text(page) == "\n\n".join(["Title", *text]), page


@pytest.mark.parametrize("words", [10, 140])
def test_html_forms_and_comments(words):
    said = " ".join(["word"] * words)
    text = " ".join(["text"] * 90)
    for out in (f"<form><p>{said}</p></form>", f"<div class=comments><article class=comment><p>{said}</p></article></div>", f"<article class=comment-body><p>{said}</p></article>", f"<aside><p>{said}</p></aside>"):
        assert main_text(f"<article><p>{text}</p><p>{text}</p>{out}</article>") == f"{text}\n\n{text}", out


def test_html_names_that_are_no_furniture():
    """Texts about notices and laws, an article in an element with such a name, and main text within a named layout."""
    text, more = " ".join(["text"] * 60), " ".join(["more"] * 40)
    for inside in (f"<div class=legal><p>{more}</p></div>", f"<div class=notice-period><p>{more}</p></div>", f"<div class=has-sidebar><p>{more}</p></div>", f"<div class='post comments-open'><p>{more}</p></div>"):
        assert main_text(f"<article><p>{text}</p>{inside}</article>") == f"{text}\n\n{more}", inside
    for name in ("sidebar", "widget", "legal"):
        assert main_text(f"<body><nav>Home</nav><div class={name}><article><p>{text}</p><p>{more}</p></article></div></body>") == f"{text}\n\n{more}"
    assert main_text(f"<body><div class=widget><p>{more}</p><main><p>{text}</p></main></div><p>{more}</p></body>").split("\n\n") in ([text, more], [text])


def test_html_deep_pages_take_linear_time():
    def took(n):
        page = "".join(f"<div id=x{i}>a" for i in range(n)) + "</p></section>" * n
        began = time.process_time()
        assert main_text(page, [0] * BUCKETS).count("a") == n
        return time.process_time() - began

    took(1000)
    assert took(24_000) < 12 * took(6_000) + 0.5


def generated(rng, n):
    """Pages with known main text: furniture of a site that repeats or bears telling names, and blocks of content without any."""
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ren", "sto") for b in ("ra", "ne", "dit", "os")]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    for i in range(n):
        body = [("h1", say(5))] + [(rng.choice(["p", "p", "p", "li", "h2"]), say(rng.choice([2, 6, 25, 40]))) for _ in range(rng.randint(4, 9))] + [("p", say(30))]
        inner = "".join(f"<ul><li>{t}</li></ul>" if k == "li" else f"<{k}>{t}</{k}>" for k, t in body)
        main = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div class='xk-text'>%s</div>", "<div class='story'>%s</div>"]) % inner
        bar = "<div class='xk-promo-rail'><p>Subscribe to our daily letter today</p><p>%s</p></div>" % say(3)
        bar += rng.choice(["", f"<div class=sponsored><p>{say(rng.choice([3, 30, 120, 500]))}</p></div>"])
        yield f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav>{bar}{main}<div class='comments'><p>{say(rng.choice([3, 12, 100]))}</p></div><footer>Imprint of the site</footer></body></html>", "\n\n".join(t for _, t in body)


def test_html_on_generated_pages(spark):
    rng = random.Random(21)
    pages = list(generated(rng, 300))
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    steps = learned(df)
    assert steps[_bucket(".xk-promo-rail")] < 0 < steps[_bucket(".xk-text")] and steps == learned(df.repartition(5))
    got = {r.page_id: r.text for r in extract(df).collect()}
    right = sum(got[i] == want for i, (_, want) in enumerate(pages))
    assert right >= 0.97 * len(pages), right
    # Content words kept and furniture words let in, over all pages.
    pairs = [(collections.Counter(got[i].split()), collections.Counter(want.split())) for i, (_, want) in enumerate(pages)]
    common, said, asked = (sum(x.total() for x in z) for z in ([a & b for a, b in pairs], [a for a, _ in pairs], [b for _, b in pairs]))
    assert common / asked > 0.99 and common / said > 0.99
    assert learned(df.limit(0)) == [0] * BUCKETS and extract(df, sample=0).count() == 300


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 8)
        costs = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        price = lambda side: sum(-c if s and c < 0 else c if not s and c > 0 else 0 for c, s in zip(costs, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        assert price(minimum_cut(costs, edges)) == min(price(s) for s in itertools.product((False, True), repeat=n))


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (None, None, "<article>a</article>", 2), (2, "v", "<p>" * 5000 + "deep", 3), (2, "v", "<p>" * 5000 + "deep", 3)], "page_id long, url string, html string, text int")
    rows = extract(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id is None} == {"a"}
    assert extract(df.limit(0)).count() == 0


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(None, "text", "en", "s", 1), (-1, None, "en", "s", 1), (-2, "", None, None, None)], docs.schema)
    scored = quality_scores(docs.unionByName(odd), labels).join(labels, "doc_id", "left").collect()
    assert len(scored) == docs.count() + 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    held = [r for r in scored if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in scored if r.doc_id is not None and r.doc_id >= 0)


@pytest.mark.parametrize("rows", [[], [(1, "a b c")]])
def test_quality_without_labels(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in rows], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_scores(docs, none).collect()] == [0.5] * len(rows)
    assert good_documents(docs, none).count() == len(rows)


def test_warc_members_take_linear_time():
    """Many small members and few large ones; a cut one raises."""

    def took(n, size):
        data = b"".join(zlib.compress(bytes([65 + i % 26]) * 7 + str(i).encode() * size, 1, 31) for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.members(data)) == n
        return time.process_time() - began, data

    took(10, 10)
    assert took(40_000, 10)[0] < 8 * took(10_000, 10)[0] + 0.5
    data = took(20, 100_000)[1]
    assert [bytes(m) for m in warc.members(data)] == [bytes([65 + i % 26]) * 7 + str(i).encode() * 100_000 for i in range(20)]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(data[:-30]))


def test_warc_blocks_by_bytes(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"{i} " + "x" * (6 << 20 if i % 3 == 0 else 100)) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}"
    index = warc.normalise(spark.createDataFrame(warc.write(df, folder).collect()), folder)
    rows = index.collect()
    assert sum(r.n for r in rows) == 9 and len(rows) == 3
    got = {r.page_id: r.payload for r in warc.read(index, folder).collect()}
    assert got == {r.page_id: r.html for r in df.collect()}


def test_unescaped_in_pieces():
    rng = random.Random(3)
    for _ in range(300):
        said = "".join(rng.choice(["a", "\\", "\n", "<s>", "é"]) for _ in range(rng.randint(0, 40)))
        out = chat.escaped(chat.pa.array([said], chat.pa.large_string()))[0].as_py()
        assert all(chat.unescaped(out, step) == said for step in (1, 2, 3, 7, 1000))


LONG = """
import resource, sys
import numpy as np, pyarrow as pa
from wayleave.llm import chat, warc
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
base, n = peak(), 40 << 20
if sys.argv[1] == "chat":
    text = "word <s> \\\\" * (n // 10)
    out, spans = chat.assemble(pa.array(["assistant"]), pa.array([text], pa.large_string()), np.array([0]))
    (turn,) = chat.parsed(out[0].as_py())
    assert turn == ("assistant", text)
else:
    import zlib
    parts = warc.record(1, "u", b"x" * n, None, False)
    data = zlib.compress(b"".join(parts), 1, 31)
    (raw,) = warc.members(data)
    assert raw == b"".join(parts)
print(peak() - base)
"""


@pytest.mark.parametrize("what", ["chat", "warc"])
def test_long_turns_and_payloads_stay_bounded(what):
    """40 MB by themselves: under ten times that, much of it the test's own copies."""
    run = subprocess.run([sys.executable, "-c", LONG, what], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, check=True)
    assert int(run.stdout) < 10 * 40
    print(run.stdout)
