"""op4, op7: lossless images, checksums, hashes; main text of pages."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from echograph.llm import html_text, media


def test_payload_length():
    assert [len(media.payload_of(b"x" * n)) for n in (0, 1, 64, 65)] == [64, 64, 64, 128]


def test_round_trip_and_features(spark):
    texts = [None, "", "a" * 64, "héllo " * 1000, "a" * 64]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in media.features(media.store(df)).collect()}
    for i, t in enumerate(texts):
        payload = media.payload_of((t or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[2][1:] == rows[4][1:] and rows[0][1:] == rows[1][1:]
    assert media.features(media.store(df.limit(0))).count() == 0


def test_checksum_is_tested():
    png = bytearray(media.png_encode(media.payload_of(b"abc")))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.png_decode(bytes(png))
    with pytest.raises(ValueError):
        media.png_decode(bytes(media.png_encode(media.payload_of(b"abc")))[:-12])


def test_all_filters_are_read():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (40, 64)).astype(np.uint8)
    lines = []
    for y in range(40):
        kind = y % 5
        row = []
        for x in range(64):
            left = int(image[y, x - 1]) if x else 0
            up = int(image[y - 1, x]) if y else 0
            corner = int(image[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(p - v))
            row.append((int(image[y, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        lines.append(bytes([kind, *row]))
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 40, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.png_decode(png) == image).all()


def test_hash_is_stable_under_small_changes():
    base = np.random.default_rng(1).integers(0, 256, (200, 64)).astype(np.uint8)
    near = base.copy()
    near[5, 5] ^= 1
    bits = lambda h: bin(int(h, 16))
    assert sum(a != b for a, b in zip(bits(media.cosine_hash(base)).zfill(66), bits(media.cosine_hash(near)).zfill(66), strict=True)) <= 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- note --><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div>%s<aside>side</aside><form><label>Mail</label></form><div id="comments"><p>great post</p></div><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("body", ["<article><h1>One &amp; two</h1><p>First   line<br>goes on.<p>Second <b>bold</b>.</p></article>", "<div><h1>One &amp; two</h1><p>First   line<br>goes on.<p>Second <b>bold</b>.</p></div>"])
def test_main_text(body):
    assert html_text.main_text(PAGE % body) == "One & two\nFirst line goes on.\nSecond bold."


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div><p>A<p>B<aside><p>x<p>y<p>z</aside><p>C</div>", "A\nB\nC"),
        ('<div><p>A<p>B<div class="ad"><p>x<p>y<p>z<p>u</div><p>C</div>', "A\nB\nC"),
        ("<div><p>A<p>B<form><p>x<p>y<p>z</form><p>C<p>D</div>", "A\nB\nC\nD"),
        ('<div><p>A<p>B<ul><li><a href="/x">x</a><li><a href="/y">y</a><li><a href="/z">z</a></ul><p>C</div>', "A\nB\nx\ny\nz\nC"),
        ("<article><p>A long first part</article><p>between<article><p>B</article>", "A long first part\nB"),
        ('<div><p>First one.</p><div class="related">x</div><div class="related">y</div><div class="related">z</div><p>Third one.</p></div>', "First one.\nThird one."),
        ("<div><div><p>A is first.</div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><div><p>B is last.</div></div>", "A is first.\nx\ny\nz\nB is last."),
        ('<article><p><a href="/x">All of it is a link</a></p></article>', "All of it is a link"),
        ('<article><p>Prices.</p><div class="share-price">12 euro</div><div class="alert-systems">They ring.</div></article>', "Prices.\n12 euro\nThey ring."),
        ("<article><p>Let <math><mi>x</mi></math> be. Press <button>OK</button> now.</p></article>", "Let x be. Press OK now."),
        ('<div class="ad">A long advert that goes on and on.</div><article><h1>Hi</h1></article><footer>me</footer>', "Hi"),
        ('<div class="ad">An advert alone.</div><article></article>', ""),
        ('<body class="sidebar"><div class="has-comments no-sidebar"><h1>T</h1><p>Text.</p></div><div id="user-comments"><p>I like it.</p></div>', "T\nText."),
        ('<article><p>Story.</p><section class="comments"><article class="comment"><p>A reader speaks at length here.</p></article></section></article>', "Story."),
        ('<main><article><header><h1>T</h1><p>by me</p></header><p>One.</p><footer>tags</footer></article></main><div role="complementary"><p>more</p></div>', "T\nby me\nOne."),
        ("<ul><li><a>menu</a><li><a>other</a></ul><div><p>Words here.<p>More words.</div><ul><li><a>end</a></ul>", "Words here.\nMore words."),
        ("<p>same length<p><a>x</a><p><a>x</a><p><a>x</a><div><p>same length</div>", "same length"),
        ('<p>a "quote<p title="x>y">b</p><p title=\'open>c</p>', 'a "quote\nb\nc'),
    ],
)
def test_noise_in_mid_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("piece", ["<p ", '<b x="', "<p>a", "<div>a", "<title>", "<", "</p>", "<!--", "<a href='x\">", "<span class=ad>x", "<article><div></p>", "&amp;"])
def test_broken_markup_takes_linear_time(piece):
    import time

    took = []
    for size in (100_000, 800_000):
        page = piece * (size // len(piece))
        began = time.perf_counter()
        html_text.main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < max(1.0, 24 * took[0])


def brute_main_text(page):
    """The rule of the docstring anew, for well-formed pages of div, p, nav and a: window sums, regions, containers."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.link, self.out = [], False, []

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.link = True
            else:
                self.path.append((tag, len(self.out), self.getpos()))

        def handle_endtag(self, tag):
            if tag == "a":
                self.link = False
            else:
                self.path.pop()

        def handle_data(self, data):
            self.out.append((data, 0 if self.link else len(data), tuple(x for x in self.path if x[0] == "div"), any(x[0] == "nav" for x in self.path)))

    reader = Reader()
    reader.feed(page)
    rows = [r for r in reader.out if not r[3]]
    weights = [r[1] for r in rows] if any(r[1] for r in rows) else [len(r[0]) for r in rows]
    sums = [sum(weights[max(0, i - 2) : i + 1]) for i in range(len(rows) + 3)]  # of the window that ends at i
    runs, start = [], None
    for i, s in enumerate(sums):
        if s and start is None:
            start = i
        if not s and start is not None:
            runs.append([k for k in range(start, min(i, len(rows))) if weights[k]])
            start = None
    if not runs:
        return ""
    best = max(runs, key=lambda r: (sum(weights[k] for k in r), -r[0]))
    box = rows[max(best, key=lambda k: (weights[k], -k))][2]
    if any(rows[k][2] == () for k in best):
        own = {rows[k][2] for k in best}
        hit = [r for r in runs if {rows[k][2] for k in r} & own]
        return "\n".join(r[0] for r in rows[hit[0][0] : hit[-1][-1] + 1])
    for k, r in enumerate(rows):
        if weights[k] and (weights[k] >= 80 or r[0].endswith(".")):
            n = 0
            while n < min(len(box), len(r[2])) and box[n] == r[2][n]:
                n += 1
            box = box[:n] or box
    return "\n".join(r[0] for r in rows if r[2][: len(box)] == box)


def test_line_blocks_equal_brute_force():
    import random

    draw = random.Random(4)

    def body(depth):
        out = []
        for _ in range(draw.randint(1, 6)):
            kind = draw.random()
            word = "".join(draw.choice("abcde ") for _ in range(draw.choice([1, 8, 90]))).strip() or "x"
            word = " ".join(word.split()) + draw.choice(["", "."])
            if kind < 0.35 and depth < 4:
                out.append(f"<div>{body(depth + 1)}</div>")
            elif kind < 0.65:
                out.append(f"<p>{word}</p>")
            elif kind < 0.9:
                out.append(f"<p><a>{word}</a></p>")
            else:
                out.append(f"<nav><p>{word}</p></nav>")
        return "\n".join(out).replace("\n", "")

    for _ in range(3000):
        page = body(0)
        assert html_text.main_text(page) == brute_main_text(page), page


def test_pages_of_all_kinds(spark):
    pages = [(1, "u", PAGE % "<article><p>x</p></article>"), (2, None, None), (3, "", ""), (4, "u", "<p>cut <b"), (5, "u", "plain words"), (6, "u", "<!-- open"), (None, "u", "<p>a</p>"), (1, "u", PAGE % "<article><p>x</p></article>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.text) for r in rows) == [(0, "a"), (1, "x"), (1, "x"), (2, ""), (3, ""), (4, "cut <b"), (5, "plain words"), (6, "")]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(df.limit(0)).count() == 0
