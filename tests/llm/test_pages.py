import re

import pytest

from roomdiff.llm import pages as p

GOLDEN = [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<p>one\n two<br>three &amp; &lt;four&gt;&nbsp;five", "one two three & <four> five"),
    ("<nav>m</nav><article><h1>T</h1><p>x <b>y</b>z</p></article><footer>f</footer>", "T\n\nx yz"),
    ("<article><p>a</p><div class='ad-slot'>buy</div><p>b <span class=\"advert\">now</span> c</p></article>", "a\n\nb c"),
    ("<body class='has-sidebar'><div class='sidebar'>s</div><div id='content'><p>x</p></div></body>", "x"),
    ("<main><p>x</p><section id='comments'><article><p>I agree</p></article></section></main>", "x"),
    ("<form><article><p>in a form</p></article></form>", "in a form"), ("<p>x</p><form><label>Name</label><input></form>", "x"),
    ("<div class=ad>unclosed<article><p>kept</p></article>", "kept"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><p>x<!-- <p>no</p> --></p><textarea><p>no</textarea>", "x"), ("<p>a < b, c <3</p>", "a < b, c <3"),
    ("<div role='navigation'>n</div><div aria-hidden='true'>h</div><div style='display: none'>h</div><div hidden>h</div><p>x</p>", "x"),
    ("<p title='a>b'>q</p><p title=it's>r</p>", "q\n\nr"), ("<p>x</p><a href='unfinished", "x"), ("<header>site</header><article><header><h1>T</h1></header><p>x</p></article>", "T\n\nx"),
    ("<div class='page-with-sidebar'><p>body</p><div class='left-sidebar'>s</div></div>", "body"), ("<form><p>in a form <input></p></form>", "in a form"),
    ("<article><h1>T</h1><p>x</p><div id='related-work'><p>Others did this.</p></div></article>", "T\n\nx\n\nOthers did this."),
    ("<main><div class='notice-board'><p>Notes hang here.</p></div><p>y</p></main>", "Notes hang here.\n\ny"), ("<article><form><p>all of it</p></form></article><p>other</p>", "all of it"),
    ("<div class='layout-sidebar-right'><p>x</p></div>", "x"), ("<div class='discussion'><p>The whole page</p></div>", "The whole page"), ("<div class='widget-page'><p>x</p></div>", "x"),
    ("<article><p>x</p><div class='related-posts'><a href=1>one</a></div><div class='adSlot'>buy</div></article>", "x"), ("<div id=acme-sidebar>s</div><p>x</p>", "x"),
    ("<p>Quite a long text of the page.</p><div class='promo-of-ours'><a href=1>one two</a></div>", "Quite a long text of the page."),
    ("<p>Quite a long text of the page.</p><div class='promo-of-ours'>not links</div>", "Quite a long text of the page.\n\nnot links"),
    ("<p>x</p><div class='promo-of-ours'><a href=1>more than half of the text</a></div>", "x\n\nmore than half of the text"),
    ("<div class='menu-of-all'><a>menu</a><article><p>kept, though inside</p></article></div>", "kept, though inside"), ("<nav>only</nav>", ""), ("<form><nav>n</nav></form>", ""),
    ("<div class='cookie-notice'>c</div><div class='newsletter'>n</div><p>x</p>", "x"), ("<P>UPPER</P><SCRIPT>no</SCRIPT>", "UPPER"),
]


@pytest.mark.parametrize("page, text", GOLDEN)
def test_one_page(page, text):
    assert p.main_text(page) == text


def test_deep_and_long_pages():
    assert p.main_text("<div>" * 20000 + "x") == "x"
    assert p.main_text("<p>" + "word " * 100000) == ("word " * 100000).strip()
    assert p.main_text("<" * 5000) == "<" * 5000


def site(host, n, promo):
    return [(f"http://{host}/{k}", f"<html><body><div class='x1'>{promo}</div><div class='x2'><p>Own text {k} of the page.</p><p>More of {k}</p></div><div class='x3'><span>Read {promo}</span></div></body></html>") for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, u, h, "z", 1) for k, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, text string, low int").repartition(3)


def test_repeated_branches_of_a_site_go(spark):
    many, few = site("many.example", 12, "Buy our book"), site("few.example", 2, "Hello there")
    copies = [("http://copies.example/", "<body><p>All the same</p></body>")] * 5
    shared = [(f"http://shared.example/{k}", f"<article><h1>Weekly</h1><p>News {k}</p><div class='q9'>Read our book</div></article>") for k in range(6)]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in p.extract(frame(spark, many + few + copies + shared)).collect()}
    for k, (url, _) in enumerate(many):
        assert got[k] == (url, t := f"Own text {k} of the page.\n\nMore of {k}", len(t))
    assert got[12][1] == "Hello there\n\nOwn text 0 of the page.\n\nMore of 0\n\nRead Hello there"        # two pages say too little
    assert all(got[14 + k][1] == "All the same" for k in range(5))          # nothing else would be left
    assert all(got[19 + k][1] == f"Weekly\n\nNews {k}" for k in range(6))


def test_importance(spark):
    rows = site("a.example", 4, "Same")
    tree = p.importance(p.observed(frame(spark, rows).withColumn("host", p.host_of("url"))))
    by = {r.path: r for r in tree.collect()}
    path = 0
    for name in ("html", "body", "div.x1"):
        path = p._signed(p.hash64(f"{path}/{name}".encode()))
    assert by[path].m == 4 and abs(by[path].content) < 1e-9 and abs(by[path].inner) < 1e-9
    path = p._signed(p.hash64(f"{by[path].parent}/div.x2".encode()))
    path = p._signed(p.hash64(f"{path}/p".encode()))
    assert by[path].content == 1.0


def test_edges(spark):
    rows = [(None, None), (None, "<p>x</p>"), ("", ""), ("not an address", "<p>y</p>"), ("http://h/", None), ("http://h/", "<p>z</p>"), ("http://h/", "<p>z</p>")]
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in p.extract(frame(spark, rows)).collect())
    assert [(t, n) for _, _, t, n in got] == [("", 0), ("x", 1), ("", 0), ("y", 1), ("", 0), ("z", 1), ("z", 1)]
    assert [u for _, u, _, _ in got] == [u for u, _ in rows]
    assert p.extract(frame(spark, rows).limit(0)).count() == 0


def test_given_pages(spark):
    """Their article element is the whole content; a plain cut and strip must give the same."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    out = p.extract(pages).collect()
    assert len(out) == len(source)
    for r in out:
        body = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", "").replace("</b>", ""))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_copies_with_a_heading_keep_their_body(spark):
    page = "<article><h1>T</h1><p>A</p><p>B</p></article>"
    rows = [("http://rows.example/", page)] * 3
    rows += [(f"http://nine.example/{k}", "<article><h1>Long</h1>" + "".join(f"<p>Part {j}</p>" for j in range(30)) + "</article>") for k in range(9)]
    rows += [("http://nine.example/own", "<article><h1>Own</h1><p>Short.</p></article>")]
    rows += [("http://byline.example/", f"{page[:-10]}<div class='by'>By X</div></article>")] * 10 + [("http://byline.example/2", f"{page[:-10]}<div class='by'>By Y</div></article>")]
    rows += [(f"http://headed.example/{k}", f"<article><h1>Day {k}</h1><p>A</p><p>B</p></article>") for k in range(8)]
    got = {r.page_id: r.text for r in p.extract(frame(spark, rows)).collect()}
    assert [got[k] for k in range(3)] == ["T\n\nA\n\nB"] * 3
    assert [got[k] for k in range(3, 12)] == ["Long\n\n" + "\n\n".join(f"Part {j}" for j in range(30))] * 9 and got[12] == "Own\n\nShort."
    assert [got[k] for k in range(13, 24)] == ["T\n\nA\n\nB\n\nBy X"] * 10 + ["T\n\nA\n\nB\n\nBy Y"]
    assert [got[k] for k in range(24, 32)] == [f"Day {k}\n\nA\n\nB" for k in range(8)]


def test_equal_pages_are_one_page_of_the_tree(spark):
    once = site("a.example", 4, "Same") + site("b.example", 3, "Other")
    often = frame(spark, once + once[:2] * 7 + once[4:5] * 30).repartition(9)
    tree = [{tuple(r) for r in p.observed(df.withColumn("host", p.host_of("url"))).collect()} for df in (frame(spark, once), often)]
    assert tree[0] == tree[1] and max(r[-1] for r in tree[0]) == 4


def test_own_class_names_do_not_grow_a_host(spark):
    def sized(n):
        own = "<article class='post-{}'><section><h2>T {}</h2><ul><li><p>a {}</p></li></ul></section></article>"
        name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
        rows = [(f"http://own.example/{k}", f"<html><body><div class='top'>Our site</div>{own.format(*[name(k)] * 3)}</body></html>") for k in range(n)]
        df = frame(spark, rows)
        tree = p.importance(p.observed(df.withColumn("host", p.host_of("url"))))
        assert all(r.text == f"T {name(r.page_id)}\n\na {name(r.page_id)}" for r in p.extract(df).collect())
        return p.shared_nodes(tree).count()
    assert sized(5) == sized(60) == 4
