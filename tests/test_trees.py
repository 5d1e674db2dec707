"""Node rows, Markdown, articles, feeds and chunks: cases by hand."""

import pytest
from pyspark.sql import functions as F

from docloom.core import article, commonmark, feed
from docloom.functions import html as H
from docloom.operators import tree as T
from docloom.streaming import chunks

PAGE = "<!-- c --><div id=a class='x y'>one<p>two <b>three</b><br>four</p><script>var s</script></div><ul><li>1<li class=x>2</ul>"


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p id=a>other</p>"), (3, ""), (4, None)], "page int, html string")
    return H.node_table(df, "html", "page").cache()


def texts(df):
    return sorted((r.page, r.text_content) for r in df.collect())


def test_selection(nodes):
    assert sorted(r.name for r in T.by_class_name(nodes, "x", "page").collect()) == ["div", "li"]
    assert sorted((r.page, r.name) for r in T.by_id(nodes, "a", "page").collect()) == [(1, "div"), (2, "p")]
    assert T.by_tag_name(nodes, "li", "page", limit=1).count() == 1
    assert T.by_tag_name(nodes, "li", "page", recurse=False).count() == 0
    assert T.by_kind(nodes, "comment", "page").count() == 1
    assert {r.page: r.exists for r in T.exists(nodes, T.tested(tag_name="ul"), "page").collect()} == {1: True, 2: False}
    assert T.select(nodes, T.tested(tag_name="b", tag_contains="two "), "page").count() == 2  # any of the options
    assert T.select(nodes, T.tested(**{"class": "x"}), "page").count() == 1
    assert [r.v for r in T.by_id(nodes, "a", "page").filter("page = 1").select(T.attribute("class").alias("v")).collect()] == ["x y"]


def test_walks(nodes):
    ul = T.by_tag_name(nodes, "ul", "page")
    items = T.children(nodes, ul, "page")
    assert items.count() == 2
    assert [r.name for r in T.parents(nodes, items, "page").collect()] == ["ul"]
    assert T.siblings(nodes, items.limit(1), "page").count() == 2
    beside = sorted((r.pos, r.next_id is None, r.previous_id is None) for r in T.element_siblings(items, "page").collect())
    assert beside == [(0, False, True), (1, True, False)]
    div = T.by_tag_name(nodes, "div", "page")
    assert texts(T.text_content(nodes, div, "page")) == [(1, "onetwo threefourvar s")]
    assert texts(T.text_content(nodes, div, "page", skip=("script", "style"), breaks=True)) == [(1, "onetwo three\nfour")]
    left = T.without(nodes, div, "page")
    assert sorted(r.name for r in left.filter("page = 1 and kind = 'tag'").collect()) == ["li", "li", "ul"]
    assert T.subtrees(nodes, div, "page", own=False).filter(T.is_tag()).count() == 4


BLOCKS = [
    ("# a #\n", "<h1>a</h1>\n"), ("a\n=\n", "<h1>a</h1>\n"), ("a\n---\n", "<h2>a</h2>\n"), ("***\n", "<hr>\n"), ("    a\n", "<pre><code>a\n</code></pre>\n"),
    ("```py x\na<b\n```\n", '<pre><code class="language-py">a&lt;b\n</code></pre>\n'), ("~~~\na", "<pre><code>a\n</code></pre>\n"), ("> a\nb\n", "<blockquote>\n<p>a\nb</p>\n</blockquote>\n"),
    ("- a\n- b\n", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"), ("3. a\n\n4. b\n", '<ol start="3">\n<li><p>a</p>\n</li>\n<li><p>b</p>\n</li>\n</ol>\n'), ("- a\n  - b\n", "<ul>\n<li>a<ul>\n<li>b</li>\n</ul>\n</li>\n</ul>\n"),
    ("- [x] a\n- [ ] b\n", '<ul>\n<li><input checked="" disabled="" type="checkbox"> a</li>\n<li><input disabled="" type="checkbox"> b</li>\n</ul>\n'), ("<div>\n*a*\n</div>\n", "<div>\n*a*\n</div>\n"),
    ("a|b\n:-|-:\n1|\\|\n", '<table>\n<thead>\n<tr>\n<th align="left">a</th>\n<th align="right">b</th>\n</tr>\n</thead>\n<tbody><tr>\n<td align="left">1</td>\n<td align="right">|</td>\n</tr>\n</tbody>\n</table>\n'.replace("<tbody><tr>", "<tbody>\n<tr>")),
    ("[a]\n\n[A]: /x 'T'\n", '<p><a href="/x" title="T">a</a></p>\n'), ("", ""), ("a\n\nb", "<p>a</p>\n<p>b</p>\n"),
]
INLINES = [
    ("*a* _b_", "<em>a</em> <em>b</em>"), ("**a *b***", "<strong>a <em>b</em></strong>"), ("a_b_c", "a_b_c"), ("~~a~~ ~b~", "<del>a</del> <del>b</del>"), ("`a*b*`", "<code>a*b*</code>"), ("`` ` ``", "<code>`</code>"),
    ("[a](/x 't')", '<a href="/x" title="t">a</a>'), ("![a *b*](/x)", '<img src="/x" alt="a b">'), ("<http://x.y>", '<a href="http://x.y">http://x.y</a>'), ("<a@b.c>", '<a href="mailto:a@b.c">a@b.c</a>'),
    ("see www.x.org.", 'see <a href="http://www.x.org">www.x.org</a>.'), ("a  \nb", "a<br>b"), ("a\\\nb", "a<br>b"), ("\\*a\\*", "*a*"), ("a & b &amp; <c", "a &amp; b &amp; &lt;c"), ("<b>x</b>", "<b>x</b>"), ("[a](<b c>)", '<a href="b%20c">a</a>'),
    ("[x](y", "[x](y"), ("*a", "*a"), ("[http://a.b](/c)", '<a href="/c">http://a.b</a>'),
]


@pytest.mark.parametrize("source, html", BLOCKS)
def test_markdown_blocks(source, html):
    assert commonmark.to_html(source) == html


@pytest.mark.parametrize("source, html", INLINES)
def test_markdown_inlines(source, html):
    assert commonmark.inline_to_html(source) == html


def test_markdown_options_and_depth(spark):
    assert commonmark.to_html("~~a~~ www.x.org", gfm=False) == "<p>~~a~~ www.x.org</p>\n"
    assert commonmark.to_html("a\nb", breaks=True) == "<p>a<br>b</p>\n"
    assert commonmark.to_text("# a *b*\n\n- `c`\n") == "a b\nc"
    assert commonmark.split_cells("| a | b\\|c |") == ["a", "b|c"] and commonmark.split_cells("a", 2) == ["a", ""]
    assert commonmark.clean_url("a b%20ü") == "a%20b%20%C3%BC"

    class Loud(commonmark.Renderer):
        def paragraph(self, inner):
            return f"<P>{inner.upper()}</P>"

    assert commonmark.to_html("a", renderer=Loud()) == "<P>A</P>"
    for deep in ("> " * 4000 + "a", "- " * 3000 + "a", "*a " * 4000, "[" * 4000):
        assert "a" in commonmark.to_html(deep) or "[" in deep
    rows = H.markdown_tokens(spark.createDataFrame([(1, "# a *b*\n\n> c"), (2, None)], "i int, md string"), "md", "i").orderBy("token_id").collect()
    assert [(r.token_id, r.parent_id, r.kind, r.depth) for r in rows] == [(1, 0, "heading", 1), (2, 1, "text", 2), (3, 1, "em", 2), (4, 3, "text", 3), (5, 0, "blockquote", 1), (6, 5, "paragraph", 2), (7, 6, "text", 3)]


WORDS = "It tells of much, and more, and goes on for a while with words that make a sentence of some length. " * 3
STORY = f"""<html lang=en dir=ltr><head><title>A long title of the page | Site</title><meta property='og:site_name' content='Site &amp; Co'><meta name=author content='By Ann Other'><link rel=canonical href='/c'>
<script type='application/ld+json'>{{"@context": "https://schema.org", "@type": "NewsArticle", "headline": "A long title of the page", "datePublished": "2024-01-02", "author": [{{"name": "Ann"}}, "Bob"]}}</script></head>
<body><div class=menu>Menu and <a href=/>home</a></div><div id=wrap><div class='article-body'><h1>A long title of the page</h1><p>{WORDS}</p><p>{WORDS} <a href='more'>see</a></p>
<p style='display:none'>Hidden</p><div class=share-bar>Share this</div><table><tr><td>{WORDS}</td></tr></table><img data-src='/i.jpg'><form><input></form></div><div class=sidebar>Other things to read, of all kinds</div></div><footer>Foot</footer></body></html>"""


def test_article(spark):
    got = article.parse(STORY, "https://x.org/a/b")
    assert got["title"] == "A long title of the page" and got["byline"] == "Ann, Bob" and got["site_name"] == "Site & Co"
    assert got["published_time"] == "2024-01-02" and got["uri"] == "https://x.org/c" and (got["lang"], got["dir"]) == ("en", "ltr")
    assert got["text_content"].count("It tells of much") == 9 and got["length"] == len(got["text_content"])
    for gone in ("Menu", "Hidden", "Share", "Other things", "Foot", "A long title"):
        assert gone not in got["text_content"]
    assert 'href="https://x.org/a/more"' in got["content"] and 'src="https://x.org/i.jpg"' in got["content"] and "<table" not in got["content"]
    plain = article.parse(STORY, json_ld=False)
    assert plain["byline"] == "Ann Other" and plain["published_time"] is None
    assert article.parse("") is None and article.parse("<p></p>") is None
    rows = spark.createDataFrame([(1, STORY, "https://x.org/"), (2, None, None), (3, "", None)], "i int, html string, url string")
    assert {r.i: r.t for r in rows.select("i", H.article("html", "url")["title"].alias("t")).collect()} == {1: got["title"], 2: None, 3: None}


@pytest.mark.parametrize("given, title", [("A page of news | Site", "A page of news"), ("One | Two", "Two"), ("Section: The long story here", "The long story here"), ("Plain", "Plain"), ("  a   b  ", "a b")])
def test_clean_title(given, title):
    assert article.clean_title(given) == title


def test_article_parts():
    assert article.clean_byline("By  Ann -") == "Ann" and article.clean_byline("written by Bob | ") == "Bob"
    assert article.similarity("a b c", "a b") == 1 and article.similarity("a", "b c") == 0 and article.similarity("", "a") == 0
    assert article.table_size([("", ["", "2"]), ("3", ["1"])]) == (4, 3)
    deep = "<div>" * 300 + WORDS
    assert article.parse(deep)["length"] > 100


def test_feed(spark):
    rss = "<rss><channel><title>T &amp; &eacute;</title><link>l</link><description><![CDATA[a<b]]></description><item><title>1</title><link>x</link></item><item><link/></item></channel></rss>"
    assert feed.parse(rss) == {"type": "rss", "title": "T & &eacute;", "link": "l", "description": "a<b", "items": [{"title": "1", "link": "x"}, {"title": "", "link": ""}]}
    atom = "<feed><title>F</title><link href='u'/><subtitle>s</subtitle><entry><title>e</title></entry></feed>"
    assert feed.parse(atom) == {"type": "atom", "title": "F", "link": "", "description": "s", "items": [{"title": "e", "link": ""}]}
    assert feed.parse("<html></html>") is None
    assert [r.t for r in spark.createDataFrame([(rss,), (None,), ("",)], "x string").select(H.feed("x")["type"].alias("t")).collect()] == ["rss", None, None]


def test_chunks(spark, tmp_path):
    parts = [("a", 1, "x</", False), ("a", 0, "<p>", False), ("a", 2, "p>", True), ("b", 0, "<b>y", False), ("c", 0, None, True)]
    df = spark.createDataFrame(parts, "key string, seq long, chunk string, last boolean")
    assert sorted(tuple(r) for r in chunks.documents_of_table(df).collect()) == [("a", "<p>x</p>"), ("c", "")]
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = chunks.documents(stream).writeStream.format("memory").queryName("chunk_nodes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [(r.key, r.kind, r.name, r.data) for r in spark.table("chunk_nodes").orderBy("key", "node_id").collect()] == [("a", "tag", "p", ""), ("a", "text", "", "x")]


def test_large_strings_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(H, "SLICE", 10)
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "<p>" + "x" * i + "</p>") for i in range(40)], "i int, html string").repartition(1)
    assert {r.i: r.t for r in df.select("i", H.text("html").alias("t")).collect()} == {i: None if i % 3 == 0 else "x" * i for i in range(40)}
    assert df.filter(F.col("i") < 0).select(H.text("html").alias("t")).count() == 0


CUT = "<html><head><title>A &amp;&amp</title></head><body><article><h1>A &amp;&amp</h1><p>B&copy; &am &#38;</p></article></body></html>"


def test_article_text_decodes_ended_references_alone(spark, tmp_path):
    """As the query's SQL does; nodes of other callers follow the HTML standard."""
    import duckdb

    from docloom import catalogue

    spark.createDataFrame([(1, "u", CUT.replace(" &#38;", ""))], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = catalogue.queries()["html_article_text"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.execute(catalogue.oracle_sql()["html_article_text"]).fetchall() == [(1, "A &&ampB© &am")]
    other = H.node_table(spark.createDataFrame([(1, CUT)], "page int, html string"), "html", "page")
    assert texts(T.text_content(other, T.by_tag_name(other, "article", "page"), "page")) == [(1, "A &&B© &am &")]


def test_counts_decode_ended_references_alone(spark, tmp_path):
    import duckdb

    from docloom import catalogue

    spark.createDataFrame([(1, "u", CUT), (2, "u", "<p>&amp</p>")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted((r.page_id, r.title) for r in catalogue.queries()["html_counts"](spark, str(tmp_path)).collect())
    want = con.execute(f"SELECT page_id, title FROM ({catalogue.oracle_sql()['html_counts']}) ORDER BY 1").fetchall()
    assert got == want == [(1, "A &&amp"), (2, "")]


def test_counts_have_a_row_for_each_page(spark, tmp_path):
    """Null and empty pages, shared ids and null ids. The SQL says one directive for any page; here they are counted."""
    import duckdb

    from docloom import catalogue

    page = "<!DOCTYPE html><head>%s</head><body><!-- c --><p>x</p></body>"
    rows = [(1, None), (2, ""), (3, page % "<title>a</title>"), (3, page % "<title>b</title><!-- d -->"), (None, page % "<title>c</title>"), (4, page % "<title></title>"), (5, page % ""), (6, page % "<title>d</title><title>e</title>"), (7, "x")]
    spark.createDataFrame([(i, "u", x) for i, x in rows], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted((tuple(r) for r in catalogue.queries()["html_counts"](spark, str(tmp_path)).collect()), key=str)
    want = sorted(con.execute(catalogue.oracle_sql()["html_counts"]).fetchall(), key=str)
    found = {1: None, 2: 0, 7: 0}
    assert got == [(i, n, found.get(i, m), x) for i, n, m, x in want] and len(got) == len(rows)
    counted = T.counted(H.node_table(spark.createDataFrame(rows[2:], "page long, html string").filter("page > 3"), "html", "page"), "page")
    assert sorted((r.page, r.n_comment, r.n_directive, r.title) for r in counted.collect()) == [(4, 1, 1, None), (5, 1, 1, None), (6, 1, 1, "d"), (7, 0, 0, None)]
