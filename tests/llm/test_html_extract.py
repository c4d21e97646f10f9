import html
import itertools
import random
import re
import time

from tremor.llm import html_extract as op

MODEL = op.default_model()
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy &amp; sell now</div><article><h1>The   title &lt;1&gt;</h1><p><b>First  paragraph,
with <a href="/x">a link</a>.<br><p>Second&nbsp;one &copy; here</article><section id="comments"><h3>Comments</h3><div class="comment"><p>I like it very much, thanks.</p></div></section><form><p>Mail us</p><input></form><footer>&copy; me</footer>"""


def test_page():
    assert op.extract(PAGE, MODEL) == "The title <1>\nFirst paragraph, with a link.\nSecond one © here"


def test_defined_results(spark):
    rows = [(1, "u", None, 1, "x"), (2, None, "", 1, "x"), (3, "u", PAGE, 1, "x"), (3, "u", PAGE, 1, "x"), (None, "u", "<p", 1, "x"), (5, "u", "<article><p>" + "word " * 50_000 + "</p></article>", 1, "x"), (6, "u", "<div>" * 3000 + "deep" + "</b></div>", 1, "x"), (7, "u", "<script>never closed <p>x", 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    got = {}
    for r in op.extract_pages(pages).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert got[1][0].text == got[2][0].text == got[7][0].text == "" and len(got[3]) == 2
    assert got[5][0].n_chars == 5 * 50_000 - 1
    assert op.extract_pages(pages.limit(0)).count() == 0


def test_marginals_against_enumeration():
    page = op.Page("<div class='content'><p>One two three, four.</p><nav>A <b>b</b></nav></div><footer>c</footer>")
    n = len(page.parent)
    weight = {}
    for y in itertools.product((0, 1), repeat=n):
        w = MODEL.prior if y[0] else 1 - MODEL.prior
        for i in range(n):
            if y[i]:
                w *= 2.718281828459045 ** (sum(MODEL.odds.get(f, 0.0) for f in page.features[i]))
            if i:
                w *= MODEL.table(page.kind[i])[y[page.parent[i]]][y[i]]
        weight[y] = w
    total = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(MODEL.marginals(page), want, strict=True))


def test_held_out_labelled_pages():
    right = wrong = missed = 0
    for source in op.labelled_pages(150, seed=77):
        page = op.Page(source)
        for t, y, p in zip(page.text, op.labels_of(page), MODEL.marginals(page), strict=True):
            if t is not None:
                right += (p > 0.5) == y
                wrong += p > 0.5 and not y
                missed += p <= 0.5 and y
    assert right / (right + wrong + missed) > 0.9 and wrong / right < 0.03


def test_broken_markup_is_read_in_one_pass():
    """Tags and quotes that never close, at a length at which reading on from each of them would take hours."""
    n = 60_000
    for source in ("<a " * n, "<p>x" + "<a b='" * (n + 1), '<p title="x>' * (n + 1), "<a <b " * n + '"', "<section>" * 3000 + "</div>" * n, "<p>" + "</b>" * n, "<" * n, "<!-- " * n, "<p><i '" + "<b>x</b> " * n):
        began = time.time()
        op.Page(source)
        assert time.time() - began < 20, source[:20]
    assert op.extract("<article><p>One two, three. <a 'x </p><p>Four five, six.</p></article>", MODEL) == "One two, three. <a 'x\nFour five, six."


def test_tag_ends_against_the_pattern():
    rng = random.Random(3)
    for _ in range(300):
        source = "<a" + "".join(rng.choice(" b>'\"<") for _ in range(rng.randint(0, 14)))
        assert op._Ends(source).closed(op._HEAD.match(source).end()) == (op._TOKEN.match(source).group(2) is not None)


def test_articles_of_the_test_data():
    import pyarrow.parquet as pq

    for row in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist():
        inside = row["html"][row["html"].index("<article>") + 9 : row["html"].index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert op.extract(row["html"], MODEL) == "\n".join(b for b in blocks if b)
