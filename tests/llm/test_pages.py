import pytest

from lodestream.llm import html_text as H


@pytest.fixture(scope="module")
def net():
    return H.train_labeller(pages=500, rounds=150)


def test_blocks():
    page = "<!doctype html><title>T &amp; t</title><style>p{}</style><script>if (a<b) '</p>'</script><body><p>One <b>bo</b>ld\n  text<br>more<p>Two &lt;x&gt;<!-- <p>no</p> --><ul><li>a<li>b</ul><a title='it>s'>link</a> 3 < 4"
    assert [b.text for b in H.leaf_blocks(page)] == ["T & t", "One bold text more", "Two <x>", "a", "b", "link 3 < 4"]
    long = "<div style='" + "x" * 6000 + "' data-a=\"class=no id=no\" CLASS=side>in</div><svg><p>drawn</p><p>after <math><mi>x</mi></math>"
    assert [(b.path[0], b.text) for b in H.leaf_blocks(long)] == [(("div", ".side"), "in"), (("svg",), "drawn"), (("svg",), "after x")]
    for odd in ("", "<", "<p", "<!--", "<!-- x", "</p></p>", "<script>", "<p title=\"x", "plain", "<br/><hr>", "&nbsp;&bogus;", "<" * 5000, "<a '" * 3000):
        H.leaf_blocks(odd)


def test_gradients():
    import numpy as np

    grammar = H.Grammar(1)
    some = [grammar.page() for _ in range(3)]
    net = H.train_labeller(pages=5, rounds=1)
    f = H.features([b for blocks, _ in some for b in blocks])
    sizes, y = np.array([len(b) for b, _ in some]), np.array([x for _, v in some for x in v])
    for name in ("path", "word", "wx", "wh", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    _, grads = H._gradients(net, f, sizes, y)
    for name, g in zip(("path", "word", "wx", "wh", "out"), grads):
        p = getattr(net, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, ends = p[at], []
        for d in (1e-2, -1e-2):
            p[at] = old + d
            ends.append(H._gradients(net, f, sizes, y)[0])
        p[at] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - g[at]) < 0.02 * abs(g[at]) + 1e-5


def test_held_out_pages(net):
    grammar = H.Grammar(777)
    pages = [grammar.page() for _ in range(150)]
    got = H.label_blocks(net, [b for b, _ in pages])
    want = [x for _, y in pages for x in y]
    assert sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want)


def test_extract(spark, net, sf_dir):
    rows = [(1, "u", "<nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>Body   text &eacute;</p><p>Second</p></article><footer>© 2020</footer>", "clash"), (2, None, None, None), (3, "u", "", "x"), (None, "u", "<p>", "x"), (1, "u", "<article><p>" + "word " * 200_000 + "</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract(df, net)
    assert out.columns == ["page_id", "url", "html", "text"]
    got = {(r["page_id"], len(r["html"] or "")): r["text"] for r in out.collect()}
    assert got[(1, len(rows[0][2]))] == "Head\n\nBody text é\n\nSecond"
    assert got[(2, 0)] == "" and got[(3, 0)] == "" and got[(None, 3)] == ""
    assert got[(1, len(rows[4][2]))] == ("word " * 200_000).strip()
    assert H.extract(df.limit(0), net).count() == 0


def test_pages_of_the_driver(spark, net, sf_dir):
    """Held-out accuracy on real templates: what stands in <article> is the article there."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    blocks = [H.leaf_blocks(x) for x in pages]
    got = H.label_blocks(net, blocks)
    want = [any(p[0] == "article" for p in b.path) for x in blocks for b in x]
    assert sum(a == b for a, b in zip(got, want)) >= 0.995 * len(want)


def plain_extraction(source):
    """The text of <article>, by the standard library's parser: blocks end where a block element's tag stands."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.parts, self.blocks = 0, [], []

        def flush(self):
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append(text)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.parts.append(" ")
            elif tag not in ("b", "a"):
                self.flush()
                self.inside += tag == "article"

        def handle_endtag(self, tag):
            if tag not in ("b", "a"):
                self.flush()
                self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    reader = Reader()
    reader.feed(source or "")
    reader.close()
    reader.flush()
    return "\n\n".join(reader.blocks)


def test_query_against_a_plain_extraction(spark, sf_dir):
    from lodestream.llm import queries

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op4_html_text(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    assert all(len(text) == n for text, n in got.values())
    assert sum(got[i][0] == plain_extraction(x) for i, x in pages.items()) >= 0.99 * len(pages)
