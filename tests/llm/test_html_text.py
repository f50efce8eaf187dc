import pytest

from breaklens.llm.html_text import PageTree, main_text, without


def text(page):
    return " ".join(r["text"] for r in PageTree(page).kept())


@pytest.mark.parametrize(("page", "want"), [
    ("<article><h1>T &amp; t</h1><p><b>One<br>two.<p>a<b>b</b>c &copy; &#233; &am</article><footer>f</footer>", "T & t One two. abc © é &am"),
    ("<nav>n</nav><div class='ad'>x</div><p>body</p><aside>s</aside><form>f</form>", "body"),
    ("<script>var t=\"</p>\";</script><style>p{}</style><!-- c --><main>m<ul><li>1<li>2</ul></main>outside", "m 1 2"),
    ("<article>a<div class=\"reader comments\"><p>no</p></div><p hidden>no</p>b</article>", "a b"),
    ("<div id=cookie-notice>no</div><div role=navigation>no</div><td>x</td><td>y</td>", "x y"),
    ("plain &lt;text&gt; 1 < 2 and  more", "plain <text> 1 < 2 and more"),
    ("<p>never <b>closed", "never closed"), ("<a href='x", ""), ("<p>x</p></div></article>y", "x y"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("", ""), ("<article></article>", ""),
    ("<p>a  \n b&nbsp;c</p>", "a b c"), ("<P>UP<BR/>per</P><SCRIPT>x</SCRIPT>", "UP per"),
    ("<article><header>h</header>t<button>b</button></article><article>u</article>", "t u"),
])
def test_one_page(page, want):
    assert text(page) == want


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_templates_of_a_host_go(spark):
    rows = [(i, f"http://Site.example/{i}", f"<div><div><p>Welcome to our site</p></div><p>story number {i}</p>"
             f"<p>{'same twice' if i < 2 else f'other {i}'}</p></div>") for i in range(30)]
    rows += [(100, "http://other.example/", "<div><p>Welcome to our site</p></div><p>kept here</p>"),
             (101, None, "<p>no host</p>"), (102, "http://site.example/n", None), (103, "not a url", ""),
             (0, "http://site.example/0", rows[0][2])]
    got = main_text(pages(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert len(got) == len(rows) and len(by[0]) == 2
    assert by[1][0].text == "story number 1 same twice" and by[1][0].n_template == 2
    assert by[7][0].text == "story number 7 other 7"
    assert by[100][0].text == "Welcome to our site kept here" and by[100][0].n_template == 0
    assert [by[k][0].text for k in (101, 102, 103)] == ["no host", "", ""]


def test_declared_content_is_no_template(spark):
    rows = [(i, "http://h.example/x", f"<nav><a>menu</a></nav><article><p>a{i}</p><p>Same licence.</p></article>") for i in range(20)]
    for r in main_text(pages(spark, rows)).collect():
        assert r.text == f"a{r.page_id} Same licence." and r.n_template == 1


def test_extra_columns_and_empty_table(spark):
    rows = [(1, "http://h.example/", "<p>x</p>", "t", 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, page int")
    got = main_text(df)
    assert got.columns == ["page_id", "url", "page", "text", "n_template"] and got.first().text == "x"
    assert main_text(df.where("false")).count() == 0


def test_copies_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<nav>menu {i}</nav><div><p>A copied story.</p><p>Its end.</p></div>") for i in range(6)]
    rows += [(i, f"http://h.example/{i}", f"<div><p>story {i}</p></div>") for i in range(6, 12)]
    for r in main_text(pages(spark, rows)).collect():
        assert r.text == ("A copied story. Its end." if r.page_id < 6 else f"story {r.page_id}")


def test_template_of_a_section_on_a_large_host(spark):
    rows = [(i, f"http://h.example/{i}", f"<p>story {i}</p>" + "<div>Section notice</div>" * (i < 6)) for i in range(200)]
    assert all(r.text == f"story {r.page_id}" for r in main_text(pages(spark, rows)).collect())


def test_recurring_group_inside_main(spark):
    rows = [(i, f"http://h.example/{i}", f"<main><div class=x7>Share this</div><div><p>story {i}</p><p>Same licence.</p></div>"
             + "<div>twice told</div>" * (i < 5) + "</main>") for i in range(12)]
    for r in main_text(pages(spark, rows)).collect():
        assert r.text == f"story {r.page_id} Same licence." + " twice told" * (r.page_id < 5) and r.n_template == 1


@pytest.mark.parametrize(("page", "want"), [
    ("<div class='has-sidebar'><article>story</article></div>", "story"),
    ("<div class='elementor-widget wide'><p>story</p></div>", "story"), ("<div id='nav-page'><main>story</main></div>", "story"),
    ("<div class=sidebar><div class=widget><article>story</article></div></div>", "story"),
    ("<div class=widget><p>a long story told here</p></div><p>end</p>", "a long story told here end"),
    ("<article><h2 id='related-work'>Related work</h2><p>t</p></article>", "Related work t"),
    ("<article>t<article class='comment'>no</article><div class='comments-area'><article>no</article></div></article>", "t"),
    ("<article class='comment'>an opinion</article>", "an opinion"),
    ("<main>t</main><section class=related><article>no</article></section>", "t"),
    ("<p>a long enough text</p><div class='widget box'>no</div><span class='ad-slot'>no</span>", "a long enough text"),
])
def test_names_of_elements(page, want):
    assert text(page) == want


def test_time_is_linear_in_nesting():
    import time
    for page in ("<div>x" * 100_000, "<div class=nav>x" * 50_000, "<p>" + "<b>y" * 50_000 + "<li>z" * 50_000,
                 "<div>" * 50_000 + "<li>a" * 50_000, "<main>" + "<blockquote><div>q" * 40_000):
        begin = time.process_time()
        PageTree(page).trees()
        kept = PageTree(page).kept()
        assert time.process_time() - begin < 12
        assert sum(len(b["trees"]) for b in kept) <= 100_001


def brute_without(page, gone):
    """Texts whose own or any enclosing element is gone are left out, by walks over all ancestors."""
    tree, out = PageTree(page), []
    for text, main, junk, e in tree.blocks:
        if junk or (tree.has_main and not main):
            continue
        while e is not None and e.main == main and not (e.digest and e.digest in gone):
            e = e.parent
        if e is None or e.main != main:
            out.append(text)
    return " ".join(out)


def test_deleted_subtrees_equal_walks_over_ancestors(rng):
    tags = ("div", "p", "ul", "li", "article", "main", "section", "b", "td", "table", "tr", "blockquote", "dl", "dt", "dd")
    for _ in range(400):
        page = "".join(rng.choice((f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f"w{rng.randint(0, 9)} "))
                       for _ in range(rng.randint(0, 60)))
        trees = PageTree(page).trees()
        for pool in (trees["trees"], trees["inner"], trees["trees"] + trees["inner"]):
            gone = {t for t in pool if rng.random() < 0.3}
            assert without(PageTree(page).kept(), gone) == brute_without(page, gone)
