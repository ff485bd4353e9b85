import html as standard
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import html
from foliospark.llm.queries import QUERIES


def article_of(page):
    """The blocks of the article element, for pages written as the given ones."""
    inside = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
    inside = re.sub(r"</?b>", "", inside.replace("<br>", " "))
    blocks = [" ".join(standard.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_query_against_the_marked_articles(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    wanted = {r.page_id: article_of(r.html) for r in pages.collect()}
    rows = QUERIES["op8_html"](spark, SF_DIR).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        assert r.text == wanted[r.page_id]
        assert r.n_chars == len(r.text)


PROSE = "This sentence is long enough to count as text of the article. " * 3


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a &lt; b&nbsp;&amp;amp;\n c<p>d", "a < b &amp; c\n\nd"),
        ("<script>x</script><style>y</style><p>z<script>cut off", "z"),
        ("<!-- a <p>no</p> --><p>yes<i>!</i></p>", "yes!"),
        ("<article><p>t</p><div class='ad'>buy</div><p>u</p></article>", "t\n\nu"),
        ("<div class=ad>open<article><p>t</p></article>", "t"),
        ("<article><header><h1>T</h1><p>by</p></header><p>t</p></article>", "T\n\nt"),
        ("<main><p>t</p><section id='comments'><article>c</article></section></main>", "t"),
        ("<nav>menu</nav><article></article><footer>f</footer>", ""),
        ("<form><p>name</p></form><article>t<aside>a</aside></article>", "t"),
        ("<article><p>a<p>b</div></article><p>after</p>", "a\n\nb"),
        ("<article><ul><li>x</li><li><a href='#'>y</a></li></ul></article>", "x\n\ny"),
    ],
)
def test_small_pages(page, wanted):
    assert html.main_text(page) == wanted


def test_surge_and_dive_without_an_article_element():
    page = (
        "<div>Home</div><div class='sidebar'><p>" + PROSE + "</p></div>"
        f"<div><h2>Title</h2><p>{PROSE}</p><p>short</p><p>{PROSE}</p></div>"
        "<div class='comments'><p>" + PROSE + "</p></div>"
    )
    text = " ".join(PROSE.split())
    assert html.main_text(page) == "\n\n".join(["Title", text, "short", text])


TEXT = " ".join(PROSE.split())


@pytest.mark.parametrize(
    "page, wanted",
    [
        (f"<body class='has-sidebar'><p>{PROSE}</p></body>", [TEXT]),
        (f"<body class='sidebar'><p>{PROSE}</p></body>", [TEXT]),
        (f"<div class='with-comments'><p>{PROSE}</p></div>", [TEXT]),
        (f"<div class='widget'><h1>T</h1><p>{PROSE}</p></div><p>x</p>", ["T", TEXT]),
        (f"<div class='widget'><p>{PROSE}</p></div>", [TEXT]),
        (f"<article class='post comments-open'><p>{PROSE}</p></article>", [TEXT]),
        ("<article><section id='related-work'><h2 id='search'>S</h2><p>a</p></section></article>", ["S", "a"]),
        ("<article><p id='notice-period'>a</p><section id='search'><p>b</p></section></article>", ["a", "b"]),
        ("<article><p>a</p><div class='cookie-banner'>c</div><div id='commentList'>d</div></article>", ["a"]),
        ("<article><p>a</p><div class='x share-buttons'>c</div><div role='search'>d</div></article>", ["a"]),
    ],
)
def test_names_that_only_mention_an_aside(page, wanted):
    found = [line for line in html.main_text(page).split("\n\n") if line != "x"]
    assert found == wanted


@pytest.mark.parametrize(
    "page, wanted",
    [
        # What attribute values say is no attribute.
        ("<article><p title='the hidden costs of x'>a</p></article>", ["a"]),
        (f"<div class='clip hidden md:block'><article><p>{PROSE}</p></article></div>", [TEXT]),
        ("<article><p hidden>x</p><p aria-hidden='false'>a</p><p aria-hidden=true>x</p></article>", ["a"]),
        ("<article><p style='color:red;display: none'>x</p><p style='display:block'>a</p></article>", ["a"]),
        # A form around the page is the page.
        (f"<form id=aspnet><p>{PROSE}</p><select><option>x</option></select></form>", [TEXT]),
        (f"<form id=aspnet><div>Home</div><article><p>{PROSE}</p></article></form>", [TEXT]),
        (f"<p>x</p><form id=aspnet><p>{PROSE}</p><p>b</p></form>", [TEXT, "b"]),
        (f"<article><p>{PROSE}</p><form><p>Your name</p><button>Send</button></form></article>", [TEXT]),
        # Articles in comments and among related pages are not the page's.
        (
            f"<article><p>{PROSE}</p></article><ol class='comment-list'><li>"
            f"<article class='comment-body'><p>{PROSE * 3}</p></article></li></ol>",
            [TEXT],
        ),
        (f"<main><p>a</p><ol class='comments'><li><article>{PROSE}</article></li></ol></main>", ["a"]),
        (f"<main><p>a</p><div class='post-comments'><article>{PROSE}</article></div></main>", ["a"]),
        (f"<main><p>a</p><div class='user-comments'><p>{PROSE}</p></div></main>", ["a"]),
        (f"<main><p>a</p><section class='discussion'><article>{PROSE}</article></section></main>", ["a"]),
        ("<main><section class='discussion'><h2>Discussion</h2><p>a</p></section></main>", ["Discussion", "a"]),
        ("<article><p>a</p><div class='related-posts'><p>x</p></div></article>", ["a"]),
        ("<article><p>a</p><div class='related-articles'><article>x</article></div><p>b</p></article>", ["a", "b"]),
        ("<article><p>a</p><div class='cookie-policy-banner'>x</div></article>", ["a"]),
        ("<article><div class='entry-header'><h1>T</h1></div><div class='post-body'>a</div></article>", ["T", "a"]),
        ("<article><div class='post-title'>T</div><div class='article-text'>a</div></article>", ["T", "a"]),
        # Within a line.
        ("<article><p>Energy <math><mi>E</mi><mo>=</mo><msup><mi>mc</mi><mn>2</mn></msup></math> holds.</p></article>", ["Energy E=mc2 holds."]),
        ("<article><p>a <button>x</button> b</p></article>", ["a b"]),
        ("<article><p>a <button><div>x</div></button>b</p><p>c</p></article>", ["a b", "c"]),
        ("<article><p>See <span class='tags'>x</span> y</p><p>z</p></article>", ["See y", "z"]),
        ("<article><p>See <span class='ad'>x</p><p>z</p></article>", ["See", "z"]),
        ("<article><p>a<select><option>x<option>y</select>b</p></article>", ["ab"]),
    ],
)
def test_parts_that_look_like_others(page, wanted):
    assert [line for line in html.main_text(page).split("\n\n") if line != "x"] == wanted


AD = "<div class='ad'>buy this</div>"
REST = "<div class='sidebar'>s</div>"


@pytest.mark.parametrize(
    "page, wanted",
    [
        (
            f"<body><h1>T</h1>{AD}<p>intro</p>{AD}<p>{PROSE * 20}</p>{AD}<p>end</p></body>",
            ["T", "intro", " ".join((PROSE * 20).split()), "end"],
        ),
        (
            f"<div>Home</div>{REST}<div><div>T</div>{AD}<div>{PROSE * 20}</div>{AD}<div>end</div></div>",
            ["T", " ".join((PROSE * 20).split()), "end"],
        ),
        (
            f"<div><a href='#'>Menu</a></div><div><p>{PROSE}</p><ul><li><a href='#'>one</a></li></ul>"
            f"<p>{PROSE}</p><h2>Links</h2><ul><li><a href='#'>two</a></li></ul></div>{REST}"
            "<div><a href='#'>Imprint</a></div><div>(c)</div>",
            [TEXT, "one", TEXT, "Links", "two"],
        ),
    ],
)
def test_adverts_and_links_inside_an_unmarked_article(page, wanted):
    found = html.main_text(page).split("\n\n")
    assert [line for line in found if line != "(c)"] == wanted


def test_very_long_and_deep_pages():
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert html.main_text(deep) == "text"
    many = "<article>" + "<p>line</p>" * 20_000 + "</article>"
    assert html.main_text(many).count("line") == 20_000


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<p>a</p>", "x"), (None, None, "<p>a</p>", None), (2, "u", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract(pages)
    assert found.columns == ["page_id", "url", "html", "text"]
    assert sorted(r.text for r in found.collect()) == ["", "", "a", "a"]
    assert html.extract(pages.filter(F.lit(False))).isEmpty()
