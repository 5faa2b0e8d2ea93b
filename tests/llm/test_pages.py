"""Operators on pages."""

import gzip
import hashlib
import itertools
import random
import time
import tracemalloc
from collections import defaultdict

import pytest

from kelpstone.llm import htmltext, warc

CASES = {
    "<html><body class='has-sidebar'><div id=main><h1>T</h1><p>One<p>Two &lt;b&gt;<div class='ad-box'>buy</div><ul><li>a<li>b</ul><div class=comments><p>hi</p></div></div><footer>f": "T\nOne\nTwo <b>\na\nb",
    "<article><header><h1>Title <i>x</i></h1><p>By me</p></header><p>Text<br>more&nbsp; text</p><section class=newsletter><p>join</p></section><!-- <p>x</p> --><form>f</form><p>End</article><article class=comment>nice</article>": "Title x\nText more text\nEnd",
    "<article><div class='article-header'><h1>T</h1></div><div id=cookie-notice>c</div><p>x</article>": "T\nx",
    "plain text &amp; more": "plain text & more",
    "": "",
    "<p>a < b and c</p>": "a < b and c",
    "<div><p title='x>y'>q</p>": "q",
    "<main><p>M</p></main><p>out</p>": "M",
    "<p>unfinished <b": "unfinished",
    "<article><p>x<script>if(a<b){'</p>'}</script>y</p></article>": "xy",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
    "<nav>n</nav><p>x<style>p{}</style></p><aside>s</aside><div style='display: none'>h</div><p hidden>h</p><!-- open": "x",
}


@pytest.mark.parametrize("source", list(CASES))
def test_main_text(source):
    assert htmltext.Page(source).main_text() == CASES[source]


ARTICLE = "<article><h1>T</h1><p>One.</p><p>Two.</p></article>"
BODY = "<h1>T</h1><p>One.</p><p>Two.</p>"
WRAPPED = [
    f'<div class="layout has-sidebar">{ARTICLE}<div class="sidebar"><p>Aside text that is much longer than the article itself, of all things.</p></div></div>',
    f'<div class="content-sidebar-wrap"><main>{BODY}</main><div class="sidebar"><p>aside</p></div></div>',
    f'<div id="page" class="no-sidebar">{ARTICLE}</div>',
    f'<div class="post with-comments">{BODY}<div id="comments"><p>A comment, and a very long one, longer than all the rest of the page together, it goes on.</p></div></div>',
    f'<div class="ad-free-content">{BODY}</div>',
    f'<div class="header-image-post">{ARTICLE}</div>',
    f'<div class="sidebar-left">{ARTICLE}</div>',
    f'<body class="comments-open menu-enabled">{ARTICLE}<section class="comments"><article><p>A comment that is longer than the whole of the article above it.</p></article></section>',
    f'<form id="aspnetForm"><div class="header"><p>Site</p></div>{ARTICLE}<input name=q></form>',
    f'<form action="/"><div>{BODY}</div></form>',
    f"<html><head><title>x</title><body>{ARTICLE}",
    f"<head><title>x</title><meta charset=utf-8>{ARTICLE}",
    f'<div class="widget"><article><p>teaser</p></article></div><div id="content">{BODY}<p></p></div>',
    f'<main>{BODY}</main><section><article><p>x</p></article></section>',
    f'<h1>Site</h1><div class="layout-with-sidebar overlay">{ARTICLE}</div>',
    f'<div class="has-banner"><div class="banner"><p>Big sale, everything must go, and it must go today, not tomorrow.</p></div>{ARTICLE}</div>',
]


@pytest.mark.parametrize("source", WRAPPED)
def test_layout_wrappers_keep_the_article(source):
    assert htmltext.Page(source).main_text() == "T\nOne.\nTwo."


def test_inline_elements_in_prose_stay_whatever_their_class():
    assert htmltext.Page('<p>Para <a class="share-link">linked words</a> <span class="ad">here</span> end</p>').main_text() == "Para linked words here end"
    assert htmltext.Page('<article><p>Text</p><a class="share-link">Share</a></article>').main_text() == "Text"


def made_page(rnd):
    """A page of random layout, and its main text."""
    words = lambda low, high: " ".join(rnd.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod".split()) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(low, high)))
    wraps = ["content", "layout has-sidebar", "no-sidebar", "content-sidebar-wrap", "page with-comments", "ad-free", "inner", "row", "post-body", "col-8", "header-image-post", "comments-closed"]
    furniture = [
        lambda: f'<nav><ul><li><a href="/">{words(1, 3)}</a></li></ul></nav>', lambda: f'<div class="{rnd.choice(["ad", "ad-box", "sponsored", "promo"])}"><p>{words(2, 9)}</p></div>',
        lambda: f'<aside>{words(2, 20)}</aside>', lambda: f'<div class="{rnd.choice(["sidebar", "site-sidebar", "widget", "rail"])}"><p>{words(2, 20)}</p></div>', lambda: f"<script>var x = '<p>{words(1, 3)}</p>';</script>",
        lambda: f"<style>p {{ color: {words(1, 1)} }}</style>", lambda: f"<!-- <p>{words(1, 3)}</p> -->", lambda: f'<form><label>{words(1, 2)}</label><input><button>{words(1, 2)}</button></form>',
        lambda: f'<div class="{rnd.choice(["share", "social-links", "newsletter-signup", "cookie-notice", "breadcrumbs"])}">{words(1, 6)}</div>', lambda: f'<div hidden><p>{words(1, 9)}</p></div>',
    ]
    some = lambda share: "".join(f() for f in furniture if rnd.random() < share)
    blocks, markup = [], []
    for k in range(rnd.randint(4, 12)):
        x, y = words(8, 40), words(1, 6)
        kind = "h1" if k == 0 else rnd.choice(["p", "p", "p", "h2", "link", "list", "quote", "bold", "break", "entity", "open"])
        if kind in ("p", "h1", "h2"):
            blocks.append(x)
            markup.append(f"<{kind}>{x}</{kind}>")
        elif kind == "open":
            blocks.append(x)
            markup.append(f"<p>{x}")
        elif kind == "link":
            blocks.append(f"{x} {y} {x}")
            markup.append(f'<p class="text">{x} <a class="share-link" href="?a=1&amp;b=2">{y}</a>\n {x}</p>')
        elif kind == "list":
            blocks += [x, y]
            markup.append(f"<ul><li>{x}<li>{y}</ul>")
        elif kind == "quote":
            blocks.append(x)
            markup.append(f"<blockquote><p>{x}</p></blockquote>")
        elif kind == "bold":
            blocks.append(f"{x} {y}")
            markup.append(f"<p>{x} <b>{y}</b></p>")
        elif kind == "break":
            blocks.append(f"{x} {y}")
            markup.append(f"<p>{x}<br>{y}</p>")
        else:
            blocks.append(f"{x} & <{y}> é")
            markup.append(f"<p>{x} &amp; &lt;{y}&gt; &eacute;</p>")
        if rnd.random() < 0.2:
            markup.append(some(0.2))
    root = rnd.choice(["article", "main", "div", "section"])
    comments = "".join(f"<{rnd.choice(['article', 'div'])}><p>{words(3, 30)}</p></{'div' if 0 else 'article'}>" for _ in range(rnd.randint(0, 3)))
    page = f"<{root}>" + "".join(markup) + f"</{root}>"
    if rnd.random() < 0.5:
        page += f'<section class="{rnd.choice(["comments", "comment-list", "replies"])}" id="comments">{comments}</section>'
    for _ in range(rnd.randint(0, 3)):
        page = f'<div class="{rnd.choice(wraps)}">{some(0.15)}{page}{some(0.15)}</div>'
    if rnd.random() < 0.2:
        page = f'<form id="main-form">{page}</form>'
    head = f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><meta charset=utf-8>{'</head>' if rnd.random() < 0.8 else ''}"
    return f'{head}<body class="{rnd.choice(["", "has-sidebar", "comments-open", "no-js"])}"><header><a>{words(1, 3)}</a></header>{some(0.3)}{page}{some(0.3)}<footer><p>{words(2, 20)}</p></footer></body></html>', "\n".join(blocks)


def test_made_pages_give_their_whole_main_text(spark):
    rnd = random.Random(60)
    made = [made_page(rnd) for _ in range(400)]
    rows = [(i, f"http://host{i % 7}.example/{i}", page) for i, (page, _) in enumerate(made)]
    out = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    wrong = [i for i, (_, text) in enumerate(made) if out[i] != text]
    assert not wrong, (len(wrong), made[wrong[0]], out[wrong[0]])


def test_odd_pages_take_linear_time():
    odd = [
        lambda n: "<div>" * n + "x", lambda n: '<a "' * n + "x", lambda n: "<p>" * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<!--" * n, lambda n: "<div class=sidebar>" * n + "<article>x y z",
        lambda n: "<div class=ad><p>some words</p>" * n, lambda n: "<form><header>" * n + "text", lambda n: "<head>" * n + "x",
    ]
    for make in odd:
        began = time.perf_counter()
        page = htmltext.Page(make(20_000))
        page.candidates()
        page.main_text({1})
        assert time.perf_counter() - began < 10, make(2)


def test_templates_are_removed_by_host(spark, monkeypatch):
    body = lambda i: f'<div class="c"><p>Text {i} with many words that go on and on</p><div><b>Same</b> box</div><p>Again</p></div>'
    rows = [(i, f"http://h.example/{i}", body(i)) for i in range(8)] + [(50 + i, f"http://rare.example/{i}", body(i)) for i in range(3)] + [(99, None, None), (None, "::", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    for most in (500_000, -1):  # broadcast, and joined
        monkeypatch.setattr(htmltext, "BROADCAST_HASHES", most)
        out = {r.page_id: r for r in htmltext.extract(pages).collect()}
        assert all(out[i].text == f"Text {i} with many words that go on and on" for i in range(8))
        assert out[51].text.endswith("Same box\nAgain") and out[99].text == "" and out[None].text == ""
        assert all(r.n_chars == len(r.text) for r in out.values())
    assert htmltext.extract(pages.limit(0)).isEmpty()


def test_templates_go_wherever_they_occur(spark):
    """On short pages, where they are most of the text, too; not where a page was published again and again; and on large hosts, too."""
    box = '<div class="x"><div><b>Read our</b> daily letter, it comes every day at nine</div></div>'
    long = lambda i: f"<div class=c><p>{' '.join(f'w{i}x{k}' for k in range(30))}</p>{box}</div>"
    rows = [(i, "http://a/", long(i)) for i in range(20)] + [(20 + i, "http://a/", f"<p>Short {i}</p>{box}") for i in range(3)]
    rows += [(100 + i, "http://b/", f"<div class=c><p>Same article</p><p>published on and on</p>{box}</div>") for i in range(30)]
    rows += [(1000 + i, "http://c/", f"<div><p>Page {i} has many words of its own, and more of them than any box</p>{box if i % 15 == 0 else ''}</div>") for i in range(900)]
    out = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == " ".join(f"w{i}x{k}" for k in range(30)) for i in range(20))
    assert all(out[20 + i] == f"Short {i}" for i in range(3))
    assert all(out[100 + i].startswith("Same article\npublished on and on") for i in range(30))
    assert all(out[1000 + i] == f"Page {i} has many words of its own, and more of them than any box" for i in range(900))  # 60 of 900 pages


def test_article_paragraphs_are_never_templates(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><p>Own {i}</p><p>A passage that recurs.</p><div class=x>Share box</div></article>") for i in range(9)]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Own {r.page_id}\nA passage that recurs." for r in out)


PAYLOADS = [
    (1, "http://a/", ""), (2, None, None), (3, "u", "x" * 200), (4, "u\r\nv", "x" * 200), (5, "u", "line\r\n\r\nWARC/1.1\r\nfoo\r"), (6, "u", "é" * 150 + "\r"), (7, "v", "é" * 150 + "\r"),
    (None, "n", "x" * 200), (8, "big", "a\r\nbé" * 1000), (9, "big", "a\r\nbé" * 1000 + "\r\n"), (10, "e", "\r\n" * 80), (12, "e", "\r\n" * 80), (13, "q", "short"), (14, "q", "short"),
]


@pytest.mark.parametrize("segment", [1 << 20, 333, 7])
def test_warc_round_trip(spark, segment):
    pages = spark.createDataFrame([(*r, 1) for r in PAYLOADS], "page_id long, url string, html string, record_type int").repartition(3)
    path = warc.fresh(spark, "warc-test")
    warc.write(pages, path, segment_bytes=segment)
    chunks = warc.read(spark, path, chunk_bytes=100).collect()
    held = defaultdict(bytes)
    for c in sorted(chunks, key=lambda c: c.chunk_no):
        assert c.n_bytes == len(c.data) <= 100 and c.complete
        held[c.record_id] += bytes(c.data)
        if c.record_type != "revisit":
            assert c.payload_digest == hashlib.sha256(held[c.record_id]).hexdigest() and c.payload_bytes == len(held[c.record_id])
    first = {}
    for page_id, _, html in sorted(PAYLOADS, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(html or "", page_id)
    last = {c.record_id: c for c in chunks if c.last}
    for page_id, _, html in PAYLOADS:
        data = (html or "").encode()
        c = last[f"<urn:page:{'' if page_id is None else page_id}>"]
        assert (c.payload_bytes, c.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        again = len(data) >= 100 and first[html] != page_id
        assert c.record_type == ("revisit" if again else "response") and c.refers_to == (f"<urn:page:{first[html]}>" if again else None)


def test_warc_by_join_and_empty(spark, monkeypatch):
    pages = spark.createDataFrame(PAYLOADS, "page_id long, url string, html string")
    want = sorted(map(str, warc.round_trip(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", -1)
    assert sorted(map(str, warc.round_trip(pages).collect())) == want
    assert warc.round_trip(pages.limit(0)).isEmpty()


def test_torn_archive_is_told():
    rows = list(warc.chunks_of("a", [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 50\r\n\r\nonly this"], 10))
    assert rows and not rows[-1][11]


def foreign(payload: bytes, number: int) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + payload
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (number, len(block), block)


def test_archives_of_others(spark, tmp_path):
    """Records without line ends, one gzip member each, beside a plain file; in pieces of any size."""
    rnd = random.Random(9)
    payloads = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 99, 5000, 70_000)] + [b"x" * 3_000_000, b"\r\n" * 500, b"WARC/1.0\r\n\r\n"]
    with open(tmp_path / "a.warc.gz", "wb") as out:
        for i, payload in enumerate(payloads):
            out.write(gzip.compress(foreign(payload, i)))
    (tmp_path / "b.warc").write_bytes(b"".join(foreign(p, 100 + i) for i, p in enumerate(payloads)))
    held, last = defaultdict(bytes), {}
    for c in sorted(warc.read_files(spark, str(tmp_path), chunk_bytes=1000).collect(), key=lambda c: c.chunk_no):
        held[c.record_id] += bytes(c.data)
        last[c.record_id] = c
    for i, payload in enumerate(payloads):
        for name in (f"<urn:uuid:{i}>", f"<urn:uuid:{100 + i}>"):
            assert held[name] == payload and last[name].payload_digest == hashlib.sha256(payload).hexdigest() and last[name].last and last[name].complete
    whole = b"".join(foreign(p, i) for i, p in enumerate(payloads[:5]))
    want = list(warc.chunks_of("a", [whole], 100))
    for size in (1, 7, 4096):
        assert list(warc.chunks_of("a", [whole[at : at + size] for at in range(0, len(whole), size)], 100)) == want


def test_a_payload_of_200_mb_is_read_in_little_memory():
    head = foreign(b"", 1).replace(b"Content-Length: 30", b"Content-Length: %d" % (30 + (200 << 20)))[:-4]
    assert b"Content-Length: %d" % (30 + (200 << 20)) in head
    piece = b"y" * (1 << 20)
    tracemalloc.start()
    last, n = None, 0
    for row in warc.chunks_of("a", itertools.chain([head], itertools.repeat(piece, 200), [b"\r\n\r\n"])):
        last, n = row, n + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == (200 << 20) // warc.CHUNK_BYTES and last[8] == 200 << 20 and last[10] and last[11] and peak < 8 << 20


def test_a_long_payload_is_written_in_segments(spark):
    text = "é日x" * 3_000_000  # 18 MB, cut inside characters
    pages = spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string")
    began = time.perf_counter()
    out = warc.round_trip(pages).collect()
    data = text.encode()
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in out] == [(1, len(data), hashlib.sha256(data).hexdigest(), "response")]
    assert time.perf_counter() - began < 60
