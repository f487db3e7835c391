"""Operators 1 and 4: held-out accuracy, worked pages and odd inputs."""

import numpy as np
import pytest

from daybook.llm import block_labeller, html_extraction, quality_classifier
from daybook.llm.common import table
from daybook.llm.html_blocks import blocks, vectors


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in quality_classifier.op1(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([g.predicted == q for g, q in held]) > 0.95
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got.values())


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.op1(docs, none).collect()} == {0.5}
    assert quality_classifier.op1(docs.limit(0), none).count() == 0


def by_hand(docs, labels):
    """Scores in plain numpy: one Gaussian a class with shrunk covariance, by solving instead of a factor's inverse."""
    from zlib import crc32

    q = quality_classifier
    known = {}
    for d, y in labels:
        if crc32(str(d).encode()) % 3 != 1:
            known.setdefault(d, set()).add(y)
    x = {d: np.array(q.statistics(t)) for d, t in docs}
    rows = [np.array([x[d] for d, y in known.items() if y == {k}]) for k in (0, 1)]
    covs = [np.cov(r.T, bias=True) for r in rows]
    n = [len(r) for r in rows]
    pool = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    diag = np.diag(np.diag(pool))
    logs = []
    for r, c in zip(rows, covs):
        c = (1 - q.DIAGONAL) * ((1 - q.POOLED) * c + q.POOLED * pool) + q.DIAGONAL * diag + 1e-3 * np.maximum(diag, 1e-6 * np.eye(len(diag)))
        far = {d: v - r.mean(axis=0) for d, v in x.items()}
        logs.append({d: np.log(len(r) / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * v @ np.linalg.solve(c, v) for d, v in far.items()})
    return {d: 1 / (1 + np.exp(-np.clip((logs[1][d] - logs[0][d]) / np.sqrt(len(q.FEATURES)), -30, 30))) for d in x}


def test_quality_against_plain_numpy(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    both = [(r.doc_id, r.quality) for r in labels.collect()]
    both += [both[0], (both[1][0], 1 - both[1][1]), (both[5][0], 1 - both[5][1])]
    again = spark.createDataFrame([(*b, "x") for b in both], "doc_id long, quality int, log_words string")
    got = {r.doc_id: r.score for r in quality_classifier.op1(docs.withColumn("quality", docs.doc_id), again).collect()}
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], both)
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_blocks():
    page = """<!doctype html><body><!-- <p>no</p> --><script>var t="</p><p>no"</script><p>a&amp;b<b> c</b><br>d<p title="x>y">e&nbsp;f
    <ul><li>x<li>y <a href=#>z</a></ul><div>tail"""
    assert [b.text for b in blocks(page)] == ["a&b c d", "e f", "x", "y z", "tail"]
    assert blocks(None) == blocks("") == blocks("<p> </p><style>x") == []
    assert blocks("a < b <unclosed")[0].text.startswith("a < b")


@pytest.mark.parametrize("page", ["<div>x" * 40_000, "<div>" * 40_000 + "</span>x" * 40_000, "<p><td>" + "<a>" * 40_000 + "<div>y" * 40_000])
def test_deep_pages_take_linear_time(page):
    import time

    began = time.process_time()
    vectors(blocks(page))
    assert time.process_time() - began < 10  # by looking through the open elements: minutes


def test_every_word_of_a_block_counts():
    first = "word " * 300
    a, b = (vectors(blocks(f"<p>{first}{end}</p>"))[0] for end in ("one " * 300, "two " * 300))
    assert (a != b).any()


def test_labels_cell_by_cell():
    """The forward pass of the network against one written block by block and gate by gate."""
    rng = np.random.default_rng(2)
    net = block_labeller.Net.new(3, 6, 4)
    pages = [rng.standard_normal((n, 6)).astype(np.float32) for n in (1, 5, 0, 3)]
    sig = lambda z: 1 / (1 + np.exp(-z))

    def states(d, rows):
        h, c, out = np.zeros(4), np.zeros(4), []
        for x in rows:
            z = x @ net.w[d + "x"] + h @ net.w[d + "h"] + net.w[d + "c"]
            c = sig(z[4:8]) * c + sig(z[:4]) * np.tanh(z[12:])
            h = sig(z[8:12]) * np.tanh(c)
            out.append(h)
        return out

    got = block_labeller.label(net, pages)
    for page, share in zip(pages, got):
        both = zip(states("f", page), states("b", page[::-1])[::-1])
        want = [sig(np.concatenate(x) @ net.w["ow"] + net.w["oc"][0]) for x in both]
        assert np.allclose(share, want, atol=1e-5)


@pytest.fixture(scope="module")
def net(spark, sf):
    return html_extraction.fit(table(spark, sf, "pages"))


def test_pages(spark, sf, net):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r for r in html_extraction.extract(pages, net, ["page_id", "url"]).collect()}
    for r in pages.collect():
        want = "\n".join(b.text for b in block_labeller.marked(r.html) if b.main == 1)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_layouts_it_has_not_seen(spark, net):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").limit(60).collect()]
    lines = sorted({x for t in texts for x in t.split("\n") if 20 < len(x) < 400})
    pages = [block_labeller.truth(p) for p in block_labeller.layouts(lines[: len(lines) // 2], lines[len(lines) // 2 :], 80, seed=99)]
    shares = block_labeller.label(net, [vectors(p) for p in pages])
    right = np.concatenate([(s >= 0.5) == np.array([b.main == 1 for b in p]) for p, s in zip(pages, shares) if p])
    assert right.mean() > 0.9


def test_gradient():
    rng = np.random.default_rng(0)
    net = block_labeller.Net.new(1, 5, 3)
    x, mask = rng.standard_normal((4, 2, 5)).astype(np.float32), np.ones((4, 2, 1), np.float32)
    mask[3, 1] = 0
    up = rng.standard_normal((4, 2, 3)).astype(np.float32) * mask
    grad = {}
    block_labeller._back(net, "f", x, mask, block_labeller._run(net, "f", x, mask, True)[1], up, grad)
    for name in ("fx", "fh", "fc"):
        at = tuple(0 for _ in net.w[name].shape)
        both = []
        for step in (1e-2, -1e-2):
            net.w[name][at] += step
            both.append(float((block_labeller._run(net, "f", x, mask, False)[0] * up).sum()))
            net.w[name][at] -= step
        assert abs((both[0] - both[1]) / 2e-2 - grad[name][at]) < 2e-2


def plain_blocks(page):
    """(text, names of the elements around it) by the library's event parser, for pages with all their end tags."""
    from html.parser import HTMLParser

    from daybook.llm.html_blocks import BLOCK

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.held, self.out = [], "", []

        def flush(self):
            if " ".join(self.held.split()):
                self.out.append((" ".join(self.held.split()), [w for n, a in self.open for w in (n, *a)]))
            self.held = ""

        def handle_starttag(self, tag, attrs):
            if tag in BLOCK:
                self.flush()
            if tag == "br":
                self.held += " "
            elif tag not in ("img", "input", "meta", "link", "hr"):
                self.open.append((tag, [v or "" for k, v in attrs if k in ("class", "id", "role")]))

        def handle_endtag(self, tag):
            if tag in BLOCK:
                self.flush()
            if any(n == tag for n, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if not {n for n, _ in self.open} & {"script", "style", "title", "noscript"}:
                self.held += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return reader.out


def test_blocks_against_a_plain_parser(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").limit(30).collect()]
    lines = sorted({x for t in texts for x in t.split("\n") if 20 < len(x) < 300 and not set(x) & set("<>&")})
    good = 0
    for page in block_labeller.layouts(lines[::2], lines[1::2], 200, seed=5):
        if "<br><p>" in page or "<h1>" in page:  # an element left open, or closed by another name
            continue
        want = plain_blocks(page)
        assert [b.text for b in blocks(page)] == [t for t, _ in want]
        assert [bool(b.inside and b.inside.marked) for b in blocks(page)] == ["data-main" in names for _, names in want]
        good += 1
    assert good > 5


def test_fit_reads_long_pages(spark):
    rows = [(i, f"u{i}", ("<nav>Menu</nav>" + f"<article><p>{'Main text here. ' * 3}</p></article>" * 5_000), None) for i in range(3)]
    net = html_extraction.fit(spark.createDataFrame(rows, "page_id long, url string, html string, h string"))
    share = block_labeller.label(net, [vectors(blocks(rows[0][2]))])[0]
    assert share[0] < 0.5 < share[-1]


def test_extraction_of_odd_rows(spark, net):
    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, "u", "<article>" + "<p>Some words here.</p>" * 20_000, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extraction.extract(df, net, ["page_id", "url"]).collect()
    assert sorted(r.n_chars for r in got)[:3] == [0, 0, 0] and len(got) == 4
    assert html_extraction.op4(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "part,end",
    [("<a ", ""), ("<b x='", ""), ("<script x ", ""), ("<a", ""), ("<a ", "'x' 'y'"), ("<b x=\"'", "'"), ("<!--", ""), ("</", ""), ("<p>", "<i '" * 20_000 + '">')],
)
def test_tags_that_never_end_take_linear_time(part, end):
    import time

    from daybook.llm import html_blocks

    began = time.time()
    found = html_blocks.blocks("<p>one</p>" + part * 60_000 + end)
    assert found[0].text == "one" and time.time() - began < 3


def test_tags_end_where_a_pattern_says(spark):
    import random
    import re

    from daybook.llm import html_blocks

    plain = re.compile(
        rf"<!--.*?(?:-->|\Z)|<({html_blocks.RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>",
        re.S | re.I,
    )
    dice = random.Random(4)
    bits = ["<", ">", "/", '"', "'", " ", "a", "<a ", "</a>", "<script", "</script>", "<!--", "-->", "<!", "=", "<p>", "</p", "é", "\n", "<scripts>", '<A HREF="x>y">']
    for _ in range(20_000):
        page = "".join(dice.choice(bits) for _ in range(dice.randrange(25)))
        want = [(m.start(), m.end(), (m[3] or "").lower(), bool(m[3] and m[2]), m[4] or "") for m in plain.finditer(page)]
        assert list(html_blocks._tokens(page)) == want, page
