import html
import random
from html.parser import HTMLParser

import numpy as np
import pytest

from millrace.llm import html_blocks as h


@pytest.fixture(scope="module")
def network():
    made = h.Layouts(11)
    net = h.Network()
    net.fit([(h.vectors(f), y) for f, y in (made.page() for _ in range(h.GENERATED)) if f])
    return net


def test_blocks_cut_at_tags_and_decode():
    page = "<html><head><title>t</title></head><body><script>var a='<p>';</script><!-- <p>no --><p>One&amp; two<br>three\n four<p><b>Five</b> six<ul><li>a<li>b &lt;c&gt;</ul>tail<img src=x alt='a>b'> 1 < 2<div"
    assert [b.text for b in h.blocks(page)] == ["One& two three four", "Five six", "a", "b <c>", "tail 1 < 2"]
    assert h.blocks(None) == h.blocks("") == []


ARTICLE = "<article><h1>Head line</h1><p>All of it.</p></article>"


@pytest.mark.parametrize("before", [
    "<head><title>no</title><meta charset=x>", "<title>no</title>", "<title>no", "<head><title>no</title><link rel=a><body>", "<svg width=1/>", "<svg><text>no</text></svg>", "<svg><g><title>no</title>", "<template><p>no</p></template>",
    "<!-- no -->", "<!--><!-- no --!>", "<script>if (a<b) '<p>no</p>'</script>", "<STYLE>p::before{content:'no'}</style >", "<head><noscript><link href=x></noscript></head>", "<template>", "<head>\n</head>", "<p title=\"a>b\" class=it's>", "<a title='>", "</head></title>",
])
def test_the_article_is_never_swallowed(before):
    assert [b.text for b in h.blocks(before + ARTICLE)] == ["Head line", "All of it."]


@pytest.mark.parametrize("before", ["<noscript>", "<noscript><p>Turn scripts on</p></noscript>", "<head>words", "<div><template><p>", "<svg><p>"])
def test_what_precedes_the_article_may_show(before):
    assert [b.text for b in h.blocks(before + ARTICLE)][-2:] == ["Head line", "All of it."]


class Plain(HTMLParser):
    """Blocks by the standard library's parser: text between block tags."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.out, self.held, self.off = [], "", ""
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        self.out += [" ".join(html.unescape(self.held).split())] if self.held.strip() else []
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.off = tag if tag in ("script", "style", "title") else self.off
        if tag in h.BLOCK_TAGS:
            self.cut()
        self.held += " " if tag in ("br", "img", "input") else ""

    def handle_endtag(self, tag):
        self.off = ""
        if tag in h.BLOCK_TAGS:
            self.cut()

    def handle_data(self, data):
        self.held += "" if self.off else data

    def handle_entityref(self, name):
        self.held += f"&{name};"

    def handle_charref(self, name):
        self.held += f"&#{name};"


def test_blocks_equal_another_parser_and_a_long_page():
    rng, made = random.Random(3), h.Layouts(5)
    for _ in range(60):
        pieces = [p for part in rng.choices([*h.Layouts.PARTS], k=4) for p, _ in made.part(part)] + [p for p, _ in made.article()]
        pieces += rng.choices(["<script>var x = '<p>';</script>", "a &amp; b&#8217;s ", "<i>in</i> line<br>", "<style>p {}</style>", "<hr>", "<!-- <p>no</p> -->", "<img alt='x>y' src=a>", "<span class=\"a\">s</span>"], k=8)
        rng.shuffle(pieces)
        page = "<html><head><title>t</title></head><body>" + "".join(pieces) + "</body></html>"
        assert [b.text for b in h.blocks(page)] == Plain(page).out
    long = "<article>" + "".join(f"<p>number {i}" for i in range(20000)) + "</article>"
    assert len(h.blocks(long)) == 20000


def test_gradients():
    net, rng = h.Network(), np.random.default_rng(0)
    x = rng.standard_normal((4, 3, h.PATH + h.WORDS + 6)).astype(np.float32) * 0.1
    mask, y = np.ones((4, 3, 1), np.float32), (rng.random((4, 3)) > 0.5).astype(np.float32)
    mask[3, 1] = 0
    grads = net.gradients(x, mask, y)

    def loss():
        p = net.predict({d: x @ net.p["x" + d] + net.p["c" + d] for d in "fb"}, mask)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask[..., 0]).sum() / mask.sum())

    for k in ("hf", "hb", "xf", "xb", "cf", "o"):
        at = tuple(np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape))
        net.p[k][at] += 0.01
        up = loss()
        net.p[k][at] -= 0.02
        down = loss()
        net.p[k][at] += 0.01
        assert (up - down) / 0.02 == pytest.approx(float(grads[k][at]), abs=2e-3)


def test_unseen_layouts(network):
    made, right, total = h.Layouts(77), 0, 0
    pages = [p for p in (made.page() for _ in range(120)) if p[0]]
    for (_, y), p in zip(pages, h.Labeller(network).label([f for f, _ in pages]), strict=True):
        right += int(((p > 0.5) == (y > 0.5)).sum())
        total += len(y)
    assert right / total > 0.97


def test_pages(spark, network):
    body = "<nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><h1>Title</h1><p>First  text.</p><p>Second.</p></article><div class=comments><p>Nice one</p></div><footer>Foot</footer>"
    pages = spark.createDataFrame([(1, "u", body), (2, None, None), (3, "v", ""), (4, "w", "<p")], "page_id long, url string, html string")
    found = {r.page_id: (r.text, r.n_chars) for r in h.extract(pages, network).collect()}
    clash = pages.unionByName(pages).selectExpr("*", "'own' as text", "'own' as n_chars")
    assert sorted(map(str, h.extract(clash, network).collect())) == sorted(map(str, [r for r in h.extract(pages, network).collect() for _ in range(2)]))
    assert found == {1: ("Title\nFirst text.\nSecond.", 25), 2: ("", 0), 3: ("", 0), 4: ("", 0)}
    assert h.extract(pages.limit(0), network).count() == 0
