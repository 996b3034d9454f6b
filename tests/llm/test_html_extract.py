import numpy as np
import pytest

from reviewlens.llm import html_extract as H

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy this now today.</div>'
        '<article><h1>Head &amp; line</h1><p><b>First  para,\n with words.<br><p>Second&nbsp;para &lt;b&gt; here, long enough.</p>{extra}'
        '<p>Third paragraph of text, the last one.</p></article><footer>&copy; x.example.com</footer></body></html>')
WANT = "Head & line\n\nFirst para, with words.\n\nSecond para <b> here, long enough.\n\nThird paragraph of text, the last one."
SCHEMA = "page_id long, url string, html string"


def pages(n=40):
    rng = np.random.default_rng(0)
    text = lambda k: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(k)) + "."
    return [PAGE.replace("{extra}", "").replace("Third paragraph of text, the last one.", text(int(rng.integers(5, 80))))
            .replace("Buy this now today.", text(6)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return H.fit_extractor(pages())


def test_article_without_its_frame(model):
    assert H.main_text(PAGE.replace("{extra}", ""), model) == WANT


@pytest.mark.parametrize("extra", ["<form><p>Your mail</p><input name=q></form>", "<aside><p>Related things to read.</p></aside>",
                                   "<script>p</script>", "<select><option>One</select>"])
def test_parts_inside_the_article(model, extra):
    assert H.main_text(PAGE.replace("{extra}", extra), model) == WANT


def test_other_layouts(model):
    rng = np.random.default_rng(9)
    blocks = ["A title of the story"] + [f"Paragraph {i} of the story, with enough words in it to be read, and a stop." for i in range(6)]
    chrome = ["Subscribe to the letter", "We use cookies on this site", "Terms and contact", "Sponsored by a shop"]
    same = sum(H.main_text(H.lay_out(blocks, chrome, rng), model) == "\n\n".join(blocks) for _ in range(60))
    assert same >= 50


def test_decoding_has_no_contradictions(model):
    for page in pages(5) + [H.lay_out(["t", "some text here."], ["more"], np.random.default_rng(i)) for i in range(30)]:
        nodes = H.parse(page)
        x, own = H.features(nodes)
        odds = np.random.default_rng(len(page)).normal(size=len(nodes)) * 3
        keep = H.decode(nodes, odds, own)
        for i, n in enumerate(nodes):
            if n.silent or n.tag in H.NEVER:
                assert not keep[i]
        assert len(keep) == len(x)


def test_broken_markup_does_not_crash(model):
    for page in ["", "<", "<p", "</p></p>", "a < b & c", "<p class='x>y</p>", "<script>", "<!-- open", "<table><tr><td>a<tr><td>b</table>",
                 "<div>" * 3000 + "deep" + "</div>" * 3000, "<a href=\"x" * 200, "\x00<p>\x00</p>", "<p>" + "word " * 200_000]:
        H.main_text(page, model)


@pytest.mark.parametrize("start", [
    "<html><head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title><link href=x>", "<html><head></body>",
    "<head><script>var a;</script><template><div>no</div></template><noscript><img src=x></noscript><body>"])
def test_end_tag_of_head_left_out(model, start):
    page = PAGE.replace("{extra}", "")
    page = start + page[page.index("<body>") + len("<body>"):]
    assert H.main_text(page, model) == WANT
    text = [t for n in H.parse("<head><title>T</title> \n Plain words<p>more") for _, t, _ in n.texts]
    assert [t.strip() for t in text if t.strip()] == ["Plain words", "more"]


@pytest.mark.parametrize("tag", ["div", "blockquote", "center"])
def test_deep_nest_between_texts(tag):
    nodes = H.parse("<article>a" + f"<{tag}>" * 3000 + "x" + f"</{tag}>" * 3000 + "b<div></div>c<p>d</p>e</article>")
    assert H.text_blocks(nodes, [True] * len(nodes)) == ["a", "x", "bc", "d", "e"]
    nodes = H.parse("<article>a" + f"<{tag}>x" * 3000 + "</article>b")
    assert H.text_blocks(nodes, [True] * len(nodes)) == ["a"] + ["x"] * 3000 + ["b"]


def test_form_around_the_page(model):
    page = PAGE.replace("{extra}", "")
    assert H.main_text(page.replace("<body>", '<body><form id="form" action=x>').replace("</body>", "</form></body>"), model) == WANT


@pytest.mark.parametrize("tag", ["nav", "form", "menu"])
def test_unclosed_frames(model, tag):
    page = PAGE.replace("{extra}", "")
    assert H.main_text(page.replace('<div class="ad">', f'<{tag}><div class="ad">'), model) == WANT
    cut = H.main_text(page.replace("<p>Third", f"<{tag}><p>Third"), model)
    assert cut == WANT


def test_closed_frames_stay_out(model):
    for tag in ("nav", "form", "menu", "aside", "dialog", "footer"):
        page = PAGE.replace("{extra}", f"<{tag}><p>Some words that are of no matter here.</p></{tag}>")
        assert H.main_text(page, model) == WANT
    teasers = "<aside>" + "<article><p>Another story, told elsewhere at length.</p></article>" * 9 + "</aside>"
    assert "Another story" not in H.main_text(PAGE.replace("{extra}", "").replace("<footer>", teasers + "<footer>"), model)


def test_frame(spark):
    rows = [(i, f"u{i}", p) for i, p in enumerate(pages(30))]
    rows += [(0, "u0", rows[0][2]), (None, None, None), (99, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS tag")
    got = {(r["page_id"], r["url"]): r for r in H.extract_pages(df).collect()}
    assert got[0, "u0"]["text"].startswith("Head & line\n\nFirst para, with words.\n\n") and "Buy" not in got[0, "u0"]["text"]
    assert got[None, None]["text"] == "" and got[99, ""]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert H.extract_pages(df).count() == 33
    assert H.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_without_marks(spark):
    """Div-only pages: trees learn from layouts of their texts, not to keep everything."""
    rows = [(i, "u", p.replace("<article>", "<div>").replace("</article>", "</div>")) for i, p in enumerate(pages(40))]
    got = [r["text"] for r in H.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 40 and sum("Second para <b> here" in t for t in got) >= 36
    ads = [p.split('<div class="ad">')[1].split("</div>")[0] for _, _, p in rows]
    assert sum(any(a in t for a in ads) for t in got) <= 4


def test_training_on_large_pages(spark):
    """Pages padded over any former bound give the same texts as the pages themselves."""
    pad = "<script>" + "x" * 200_000 + "</script>"
    texts = []
    for page in (pages(40), [p.replace("</body>", pad + "</body>") for p in pages(40)]):
        rows = [(i, "u", p) for i, p in enumerate(page)]
        texts.append({r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()})
    assert texts[1] == texts[0] and all("Second para <b> here" in t and "Home" not in t for t in texts[1].values())
    x, y, w = H.training_rows("<article>" + "<p>word here.</p>" * 5000 + "</article>", ["more"], 50, 1)
    assert len(x) == len(y) == len(w) <= 200
