"""Main text of pages: labels by markup, several layouts, long pages, and the registered query against a plain parser."""

import tracemalloc
from html.parser import HTMLParser

import numpy as np

from presage.llm import html_blocks, queries
from presage.session import table

SF = "/root/testdata/sf0.01"
FILLER = "Some longer text of an article that goes on for a good while, as such texts do."
MENU = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"
FOOT = "<footer><p>Imprint and terms of use</p></footer>"


class Plain(HTMLParser):
    """Blocks inside the article element, by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = 0, [], ""

    def cut(self):
        if self.inside and self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
        elif tag not in html_blocks.INLINE:
            self.cut()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in html_blocks.INLINE:
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.now += data


def test_registered_query(spark):
    want = {}
    for r in table(spark, SF, "pages").collect():
        parser = Plain()
        parser.feed(r["html"] or "")
        parser.close()
        text = "\n".join(parser.blocks)
        want[r["page_id"]] = (r["url"], text, len(text))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.Q.builders["op9_html_extraction"](spark, SF).collect()}
    assert got == want


def pages_of(spark, layout, n=60):
    rows = [(i, f"u{i}", layout.replace("{i}", str(i))) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(pages, **more):
    model = html_blocks.train(pages, **more)
    return {r["page_id"]: r["text"] for r in html_blocks.extract(pages, model).collect()}


def test_main_element_without_article(spark):
    for hold in ("main", "div role=main", 'div class="post-content"'):
        pages = pages_of(spark, f"<body>{MENU}<{hold}><h1>Title {{i}}</h1><p>{{i}} {FILLER}</p><p>{FILLER}</p></{hold.split()[0]}>{FOOT}</body>")
        got = texts(pages)
        assert all(got[i] == f"Title {i}\n{i} {FILLER}\n{FILLER}" for i in got), hold


def test_comments_adverts_and_forms_inside_the_article(spark):
    inner = ('<div class="advert">Buy two, pay one</div><form><label>Your mail</label><p>We write once a week</p></form>'
             '<section class="comments"><h3>Comments</h3><article class="comment"><p>{i} I read it all and do not agree with a word of it.</p></article></section>')
    pages = pages_of(spark, f"<body>{MENU}<article><header><h1>Title {{i}}</h1></header><p>{{i}} {FILLER}</p><p>{FILLER}</p>{inner}</article>{FOOT}</body>")
    got = texts(pages)
    assert all(got[i] == f"Title {i}\n{i} {FILLER}\n{FILLER}" for i in got)


def test_own_labels():
    blocks, _, y = html_blocks.own_labels("<body class=page-with-sidebar><article class=comment>a long comment that is longer than the article</article><div class=x><article>b<aside>c</aside>d</article></div>")
    assert blocks == ["a long comment that is longer than the article", "b", "c", "d"] and y.tolist() == [0, 1, 0, 1]
    assert html_blocks.own_labels("<p>a<div>b")[2] is None and html_blocks.own_labels("")[2] is None


def test_pages_whose_markup_says_nothing(spark):
    pages = pages_of(spark, f"<body>{MENU}<td>{FILLER} {{i}} {FILLER}<td>{FILLER} {FILLER}{FOOT}</body>")
    got = texts(pages)
    assert sum("Imprint" in t or "Home" in t for t in got.values()) == 0
    assert html_blocks.train(pages_of(spark, "<a>{i}</a>")) is None  # nothing to learn from
    assert set(texts(pages_of(spark, "<a>{i}</a>")).values()) == {""}
    assert html_blocks.train(pages, sample_bytes=10) is None


def test_long_pages_in_windows():
    model = html_blocks.Labeller(5)
    page = "".join(f"<p class=c{'abcdefgh'[i % 7]}>{i} word" for i in range(20_000))
    x = html_blocks.blocks(page)[1]
    assert len(x) == 20_000 > 2 * html_blocks.WINDOW
    dense, mask = html_blocks.padded([x])
    both = np.concatenate([model.states(dense, mask, d)[0] for d in "fb"], 2)
    whole = html_blocks.sigmoid(both @ model.p["out"] + model.p["bias"])[0]
    assert np.abs(model.probabilities([x, x.part(0, 5)])[0] - whole).max() < 1e-4
    del dense, mask, both
    tracemalloc.start()
    texts, x = html_blocks.blocks("<p>a" * 100_000)
    assert len(texts) == 100_000 and tracemalloc.get_traced_memory()[1] < 60 << 20  # 400 KB of markup; dense rows would be 118 MB
    tracemalloc.stop()
