import html
import re

import edges
from tablecraft.llm import html_blocks, html_tables
from tablecraft.llm.common import table

SF_DIR = "/root/testdata/sf0.01"
NONE = frozenset()


def test_article_of_real_pages(spark):
    pages = table(spark, SF_DIR, "pages")
    want = []
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "\n", inside)).split())
        want.append((r["page_id"], r["url"], text, len(text)))
    assert edges.in_order(html_tables.extract(pages).collect()) == edges.in_order(want)


def test_parts_beside_the_article():
    page = (
        "<html><head><title>T</title><style>s</style></head><body><header>H</header><div class='cookie-notice'>C</div>"
        "<nav>n</nav><main><article><header><h1>One &amp; two</h1></header><p>a<b>b</b>&nbsp; c<br>d<p>e<ul><li>x<li>y</ul>"
        "<form>f<input></form><aside>s</aside><script>if (a < b) '</p>'</script><!-- <p>no --></article>"
        "<div id='comments'><p>no</div></main><footer>F</footer>"
    )
    assert html_blocks.main_text(page, NONE) == "One & two ab c d e x y"
    assert html_blocks.main_text("<p>one<div class='sidebar'>no</div><p>two", NONE) == "one two"
    assert html_blocks.main_text(None, NONE) == html_blocks.main_text("", NONE) == ""
    assert html_blocks.main_text("just text & more", NONE) == "just text & more"


def test_template_texts_of_a_host_go(spark):
    page = "<body><div class='top'>Welcome here</div><div class='x1'>Read all</div><div><p>Story {0} of day {0}</p></div><div>All rights kept</div></body>"
    rows = [(i, f"http://Host.example/{i}", page.format(i), "clash", "t") for i in range(30)]
    rows += [(100 + i, f"http://other.example/{i}", page.format(i), None, None) for i in range(3)]
    rows += [(None, None, None, None, None), (200, None, "", "h", "t"), (201, "http://[bad", "<p>x", "h", "t"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = {(r["page_id"], r["text"]) for r in html_tables.extract(pages).collect()}
    assert {t for i, t in got if i is not None and i < 100} == {f"Story {i} of day {i}" for i in range(30)}
    # Too few pages to tell a template from a coincidence: all text stays.
    assert (100, "Welcome here Read all Story 0 of day 0 All rights kept") in got
    assert {(None, ""), (200, ""), (201, "x")} <= got
    assert html_tables.extract(pages).count() == len(rows)
    assert html_tables.extract(pages.limit(0)).count() == 0


def test_classes_have_equal_occurrences(spark):
    from tablecraft.llm.common import Workspace

    page = "<body><div class='a'>{0}</div><ul>{1}</ul></body>"
    rows = [(i, "http://h/", page.format(i, "<li>u{}".format(i) * (i % 3)), ) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_tables.templates(pages, Workspace(spark, "test")).collect()
    root = html_blocks.number(html_blocks.OUTSIDE, "body.")
    inside = {html_blocks.number(root, "div.a"), html_blocks.number(root, "ul.")}
    assert set(found[0]["template"]) == {root} | inside


def test_copies_of_a_page_make_no_template(spark):
    article = "<body><article><h1>Head</h1><p>First part</p><p>Second part</p></article><script>{0}</script></body>"
    plain = "<body><div class='v'><p>First part</p><p>Second part</p></div><script>{0}</script></body>"
    shared = "<body><main><p>Day {0}</p><p>Shared one</p><p>Shared two</p></main></body>"
    kinds = {"article": article, "plain": plain, "shared": shared}
    rows = [(i, f"http://{k}.example/{i}", page.format(i)) for k, page in kinds.items() for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["url"].split(".")[0][7:], r["page_id"], r["text"]) for r in html_tables.extract(pages).collect()}
    for i in range(30):
        assert ("article", i, "Head First part Second part") in got
        assert ("plain", i, "First part Second part") in got
        assert ("shared", i, f"Day {i} Shared one Shared two") in got


def test_a_start_tag_cuts_off_no_text():
    cases = {
        "<svg class='i'/><p>a</p><svg><path/></svg><p>b</p>": "a b",
        "<p>a</p><math/><p>b</p><math><mi>x</mi></math>": "a b x",
        "<p>a</p><svg class='i'><p>b</p>": "a b",
        "<p>a</p><iframe src='u'><p>b</p>": "a b",
        "<p>a</p><iframe src='u'/><p>b</p><iframe>no</iframe><select><option>no</select><p>c</p>": "a b c",
        "<template><p>no</p></template><p>a</p><template><p>b</p>": "a b",
        "<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>": "a x = 1 b",
        "<object data='u'><param name='n'><p>in place</p></object><noscript><p>also</p></noscript><p>a</p>": "in place also a",
        "<svg><title/><style/><desc>no</desc><title>no</title><text>label</text></svg><p>a</p>": "label a",
        "<script src='u'/>no</script><textarea>no</textarea><p>a</p><style>no": "a",
    }
    for inside, text in cases.items():
        assert html_blocks.main_text(f"<body><article>{inside}</article></body>", NONE) == text, inside
    assert html_blocks.main_text("<noscript>Turn scripts on</noscript><p>a", NONE) == "a"
    assert html_blocks.main_text("<noscript><p>a</p><desc>b</desc>", NONE) == "a b"
    assert html_blocks.main_text("<p>a<iframe>" * 20_000, NONE).count("a") == 20_000


def test_small_hosts_and_layouts_have_templates(spark):
    page = "<body class='{1}'><div class='top'>Welcome {1}</div><div><p>Story {0}</p></div><div class='x1'>Rights {1}</div></body>"
    hosts = {"small": ["a"] * 5, "two": ["a"] * 12 + ["b"] * 8}
    rows = [(f"http://{h}.example/{i}", page.format(i, k), f"Story {i}") for h, ks in hosts.items() for i, k in enumerate(ks)]
    # A passage that some pages share is no layout: no tag is on these pages only.
    passage = "<body><div class='top'>Welcome</div><p>Day {0}</p>{1}</body>"
    for i in range(20):
        extra, text = ("<p>Shared one</p><p>Shared two</p>", " Shared one Shared two") if i < 5 else ("<p>x{0}</p><p>y{0}</p>".format(i), f" x{i} y{i}")
        rows.append((f"http://passage.example/{i}", passage.format(i, extra), f"Day {i}{text}"))
    pages = spark.createDataFrame([(k, url, html) for k, (url, html, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_tables.extract(pages).collect()}
    assert got == {k: text for k, (_, _, text) in enumerate(rows)}


def test_names_of_wrappers_and_parts_of_an_article():
    """Whole names count, not words in them; nothing but real parts beside the text goes."""
    kept = {
        "<div class='layout has-sidebar'><article><p>Hello</p></article></div>": "Hello",
        "<article class='post no-comments'><p>Hello</p></article>": "Hello",
        "<article><section class='side-effects'><p>a</p></section></article>": "a",
        "<article><h2 id='related-work'>b</h2><h2 id='discussion'>c</h2><h3 class='comments'>d</h3></article>": "b c d",
        "<article><div class='search-results-table'>e</div><figure class='share-price'>f</figure></article>": "e f",
        "<article><section class='discussion' id='comments'><p>g</p></section></article>": "g",
        "<div class='page sidebar'><main><p>h</p><form>no</form></main></div>": "h",
        "<div id='content' class='with-nav'><p>i</p></div>": "i",
        "<div class='sidebar'><article><p>teaser</p></article></div><article><p>j</p></article>": "j",
    }
    for inside, text in kept.items():
        assert html_blocks.main_text(f"<body>{inside}</body>", NONE) == text, inside
    gone = ["<div class='cookie-notice'>x</div>", "<div id='comments'>x</div>", "<ul class='main-nav'><li>x</ul>",
            "<div class='post-comments'>x</div>", "<div role='complementary'>x</div>", "<div class='ad'>x</div>",
            "<div class='sidebar-left'><p>x</p></div>", "<div class='ad-slot'>x</div>", "<form>x</form>"]
    for beside in gone:
        assert html_blocks.main_text(f"<body>{beside}<article><p>a</p></article></body>", NONE) == "a", beside
        assert html_blocks.main_text(f"<body><p>a</p>{beside}</body>", NONE) == "a", beside
    for beside in ("<div class='comments'>x</div>", "<div class='ad'>x</div>", "<aside>x</aside>", "<form>x</form>"):
        assert html_blocks.main_text(f"<article><p>a</p>{beside}<p>b</p></article>", NONE) == "a b", beside
