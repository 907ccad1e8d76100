import pytest

from lawmesh.llm import html
from tests.llm.test_models import pages

LONG = " ".join(f"word{k}" for k in range(40))


def texts(spark, body, n=6):
    rows = [(i, f"http://a.org/{i}", body.replace("{i}", str(i)).replace("{long}", f"{LONG} {i}")) for i in range(n)]
    return {r.page_id: r.text for r in html.extract_main_text(pages(spark, rows)).collect()}


def test_template_containers_in_the_article_go(spark):
    page = "<html><body><article><h1>Head {i}</h1><div class='x7'><p>Tell all your friends</p></div><p>{long}</p><table><tr><th>Name<tr><td>{i}</table></article></body></html>"
    assert texts(spark, page)[2] == f"Head 2\n{LONG} 2\nName\n2"


def test_pages_that_are_copies_keep_their_text(spark):
    page = "<html><body><article><h1>Head</h1><section><p>" + LONG + "</p></section></article></body></html>"
    assert texts(spark, page)[2] == f"Head\n{LONG}"
    other = "<html><body><article><h1>Other</h1><section><p>other text</p></section></article></body></html>"
    rows = [(i, f"http://a.org/{i}", page) for i in range(6)] + [(6 + i, f"http://a.org/x{i}", other.replace("text", f"text{i}")) for i in range(3)]
    got = {r.page_id: r.text for r in html.extract_main_text(pages(spark, rows)).collect()}
    assert (got[1], got[7]) == (f"Head\n{LONG}", "Other\nother text1")


@pytest.mark.parametrize("n", [1, 6])
@pytest.mark.parametrize(
    "wrap",
    [
        "<body class='has-sidebar'>*</body>",
        "<body><main class='with-cookie-notice'>*</main></body>",
        "<body><article class='post no-comments'>*</article></body>",
        "<body><div id='search-result-article'>*</div></body>",
        "<body><form><div>*</div></form></body>",
    ],
)
def test_names_do_not_take_the_main_text(spark, wrap, n):
    page = "<html>" + wrap.replace("*", "<p>{long}</p><div class='comments'><p>Nice {i}</p></div>") + "</html>"
    assert texts(spark, page, n)[0] == f"{LONG} 0"


def test_all_free_text_of_hosts_without_article(spark):
    page = (
        "<html><body><div class='top'><a href='/'>Menu</a></div><div class='story'><p>lead {i}</p><ul><li>point {i}</ul><div class='body'><p>{long}</p></div></div>"
        "<div class='links'><a href='/{i}'>more {i}</a></div><div class='bottom'>Always the same words here</div></body></html>"
    )
    got = texts(spark, page)
    assert got[2] == f"lead 2\npoint 2\n{LONG} 2"
    rows = [(i, f"http://b.org/{i}", page.replace("{i}", str(i)).replace("{long}", f"{LONG} {i}")) for i in range(6)]
    rows.append((9, "http://b.org/9", f"<html><body><div class='story'><p>{LONG} lead</p><div class='body'><p>little</p></div></div><p>after</p></body></html>"))
    got = {r.page_id: r.text for r in html.extract_main_text(pages(spark, rows)).collect()}
    assert got[9] == f"{LONG} lead\nlittle\nafter"
    assert got[2] == f"lead 2\npoint 2\n{LONG} 2"


def test_vectors_are_told_apart_as_whole_ones_are():
    """Equal marks of tokens for equal occurrence vectors, and only for these; the vectors are built from plain lists of places."""
    import random

    r = random.Random(2)
    made = []
    for i in range(12):
        parts = [f"<div class='c{k}'><p>text {r.randint(0, 3)}</p></div>" * r.randint(0, 2) for k in range(6)]
        made.append((i, "<html><body><div class='top'><p>same</p></div>" + "".join(parts) + "<section><p>x</p></section></body></html>"))
    tokens = html.Tokens()
    vectors = {}
    for i, page in made:
        tokens.add(i, "h", page)
        for kind, path, aside in html.parse(page):
            if kind in ("open", "close") and not aside:
                vectors.setdefault(("<" if kind == "open" else ">") + path, [0] * len(made))[i] += 1
    rows = tokens.finish()
    mark = {t: x for t, *x in zip(rows["token"], rows["pages"], rows["total"], rows["vector"], strict=True)}
    for a, v in vectors.items():
        assert mark[a][:2] == [sum(n > 0 for n in v), sum(v)]
        for b, w in vectors.items():
            assert (mark[a] == mark[b]) == (v == w)


NAMES = {"nav": "q1", "div class='ad'": "q2", "article": "q3", "footer": "q4"}


@pytest.mark.parametrize("name", [lambda k, n: f"div class='{n}'", lambda k, n: "div"])
def test_neutral_elements_and_names(spark, name):
    """Only the template is left to tell the article: menus hold links, adverts and footers lie beside the slot."""
    page = (
        "<html><head><title>t</title></head><body><{nav}><ul><li><a href='/{i}a'>go{i}</a></li><li><a href='/{i}b'>see{i}</a></li></ul></div><{div class='ad'}>Buy {i} now</div>"
        "<{article}><h1>Head {i}</h1><p>{long}</p><p>More of {i}</p></div><{footer}>&copy; site, word{i}</div></body></html>"
    )
    for k, (element, n) in enumerate(NAMES.items()):
        page = page.replace("{" + element + "}", name(k, n))
    assert texts(spark, page)[2] == f"Head 2\n{LONG} 2\nMore of 2"


def test_names_are_whole_names(spark):
    page = (
        "<html><body><article><h1>Head {i}</h1><p>{long}</p><div class='related-work'><p>Others {i}</p></div><section id='comment-on-method'><p>We note {i}</p></section>"
        "<div class='cookie-box'><p>Cookies {i}</p></div><select><option>o{i}</option></select><div class='menu-list'><a href='/'>m{i}</a></div></article></body></html>"
    )
    assert texts(spark, page)[3] == f"Head 3\n{LONG} 3\nOthers 3\nWe note 3"
