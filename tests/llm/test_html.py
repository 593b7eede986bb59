from __future__ import annotations

from itertools import product
from math import exp

import pytest

from sensorloom.llm import html as H


@pytest.fixture(scope="module")
def model():
    return H.default_model()


def test_messages_give_exact_marginals(model):
    """Against the sum over all labellings of small trees."""
    for text in ("<p>some text here</p><div class=ad>x</div>", "<article><p>word <b>in</b> bold</p></article>", "<nav><a href=x>link</a></nav><main>text</main>"):
        page = H.parse(text)
        n = len(page.tag)
        own = []
        for features in H.evidence(page):
            d = sum((model.seen.get(f) or model.unseen[f[0]])[1] - (model.seen.get(f) or model.unseen[f[0]])[0] for f in features)
            own.append((1.0, exp(max(-30, min(30, H.EVIDENCE * d)))))
        total, inside = 0.0, [0.0] * n
        for x in product((0, 1), repeat=n):
            p = 1.0
            for v in range(n):
                p *= own[v][x[v]] * (model.pair[H._kind(page.tag[v])][x[page.parent[v]]][x[v]] if v else 1)
            total += p
            for v in range(n):
                inside[v] += p * x[v]
        got = H.marginals(page, model)
        assert all(abs(got[v] - inside[v] / total) < 1e-6 for v in range(1, n))


def test_held_out_pages():
    """Trained on four fifths of the labelled pages, tried on the rest."""
    pages = H.labelled_pages()
    model = H.train([p for i, p in enumerate(pages) if i % 5 != 2])
    right = total = 0
    for p in pages[2::5]:
        page = H.parse(p)
        want, got = H.labels(page), H.marginals(page, model)
        for v in [v for v in page.flow if v >= 0 and page.text[v].strip()]:
            total += 1
            right += (got[v] > 0.5) == want[v]
    assert total > 200
    assert right >= 0.97 * total


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now.</div><article><h1>Head &amp; more</h1><p><b>Bold text of the start.<br><p>One  two
three wor<i>ds</i>.</p><p>Fish &copy; chips&nbsp;here.</p></article><footer>&copy; site &middot; words of the foot.</footer>"""


def test_page(model):
    assert H.main_text(PAGE, model) == ["Head & more", "Bold text of the start.", "One two three words.", "Fish © chips here."]


@pytest.mark.parametrize("text", [None, "", "   ", "<", "<>", "<!--", "<p", "<script>x", "</p></div>", "<a href='x", "<div>" * 20_000, "<p>" * 20_000 + "x", "&#xD800; &bogus;", "<a \"" * 3_000])
def test_odd_pages_do_not_fail(model, text):
    assert isinstance(H.main_text(text, model), list)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2), (3, "v", "", 3)], "page_id long, url string, html string, text int")
    rows = H.extract(df).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, 75, 75]
    assert {r["text"] for r in rows if r["page_id"] == 3} == {""}
    assert H.extract(df.limit(0)).count() == 0


STARTS = [
    '<svg class="icon" />', "<svg/>", "<svg><path d='x'/>", '<svg viewBox="0 0 1 1"><title>icon</title><text>drawn</text><path d="x"/></svg>', "<math/>",
    "<video src=x>", "<audio src=x>", "<object data=x>", "<canvas>", "<template>", "<noscript>", "<svg><g><g/></svg><svg/>",
]


@pytest.mark.parametrize("start", STARTS)
def test_elements_without_end_do_not_hide_the_page(model, start):
    want = ["Head & more", "Bold text of the start.", "One two three words.", "Fish © chips here."]
    assert H.main_text(PAGE.replace("<article>", start + "<article>"), model) == want
    got = H.main_text(PAGE.replace("<article>", "<article>" + start), model)
    assert got == want
    assert H.main_text(PAGE.replace("<article>", start + "<article>").replace("</article>", "</article><svg></svg><video></video><object></object>"), model) == want


def test_text_of_formulas_and_fallbacks(model):
    text = "<article><h1>Head of it</h1><p>The sum <math><mi>a</mi><mspace/><mo>+</mo><mi>b</mi></math> is here in a long sentence.</p><object><p>A fallback text of several words in the article.</p></object></article>"
    assert H.main_text(PAGE.replace("<article>", text + "<article>"), model)[:3] == ["Head of it", "The sum a+b is here in a long sentence.", "A fallback text of several words in the article."]
