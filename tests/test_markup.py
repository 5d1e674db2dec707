import pytest

from docloom.core import html as H
from docloom.core import markdown as M
from docloom.core import nested as N
from docloom.functions import html as C


@pytest.mark.parametrize(
    "markup, want",
    [
        ("<p>a<b>b<p>c", "<p>a<b>b</b></p><p>c</p>"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"),
        ("a < b &amp; c", "a &lt; b &amp; c"),
        ("<script>'</p>' < 1</script>x", "<script>'</p>' < 1</script>x"),
        ("<A HREF=x href=y>t</A></p></br>", '<a href="x">t</a><p></p><br>'),
        ("<!doctype html><!-- c --><title>&lt;</title>", "<!doctype html><!-- c --><title>&lt;</title>"),
        ("", ""),
    ],
)
def test_tree(markup, want):
    assert H.serialize(H.parse(markup)) == want


@pytest.mark.parametrize(
    "markup, want",
    [
        ("<h1>A</h1><h3>B</h3><p>c <em> d </em>e</p>", "A\n=\n\n### B\n\nc _d_ e"),
        ("<p>1. x*y_z</p>", "1\\. x\\*y\\_z"),
        ("<ul><li>a</li><li>b<ol><li>c</li><li>d</li></ol></li></ul>", "*   a\n*   b\n    1.  c\n    2.  d"),
        ("<pre><code>x\n y</code></pre>", "    x\n     y"),
        ('<a href="/u" title="t">l</a><br><img src="i" alt="A">', '[l](/u "t")  \n![A](i)'),
        ("<blockquote><p>q</p></blockquote><hr>z", "> q\n\n* * *\n\nz"),
        ("<p>a</p>\n \n<p> b  c </p><p> </p>", "a\n\nb c"),
        ("", ""),
    ],
)
def test_markdown(markup, want):
    assert M.to_markdown(markup) == want


def test_markdown_options():
    assert M.to_markdown("<h1>A</h1><b>c</b>", heading_style="atx", strong="__") == "# A\n\n__c__"
    assert M.to_markdown("<pre><code class='language-py'>```\n</code></pre>", code_block_style="fenced") == "````py\n```\n````"
    assert M.to_markdown("<table><tr><th>a<th>b<tr><td>1<td>2</table>", gfm=True) == "| a | b |\n| --- | --- |\n| 1 | 2 |"


@pytest.mark.parametrize(
    "markup, want",
    [
        ("<a href='java\nscript:x' onclick=y>k</a>", "<a>k</a>"),
        ("<a href=' JAVASCRIPT:x'>k</a><a href='&#1;javascript:x'>k</a>", "<a>k</a><a>k</a>"),
        ("<a href='/a?b:c'>k</a><a href='https://x.y'>k</a>", '<a href="/a?b:c">k</a><a href="https://x.y">k</a>'),
        ("<svg><p>x</svg><math><mi>y</math><script>z</script><style>w</style>", ""),
        ("<who>t</who><p data-a=1 style=x>u<!-- c -->", 't<p data-a="1">u</p>'),
        ("<noscript><p title='</noscript><img src=x onerror=alert(1)>'>", ""),
        ("<p title='</p><img src=x onerror=alert(1)>'>", '<p title="&lt;/p&gt;&lt;img src=x onerror=alert(1)&gt;"></p>'),
    ],
)
def test_sanitize(markup, want):
    assert H.sanitize(markup) == want


@pytest.mark.parametrize(
    "query, want",
    [
        ("a=b&c=", {"a": "b", "c": ""}),
        ("?a[b][c]=d", {"a": {"b": {"c": "d"}}}),
        ("a[]=1&a[]=2", {"a": ["1", "2"]}),
        ("a[1]=y&a[0]=x&a[15]=z", {"a": ["x", "y", "z"]}),
        ("a[100]=x", {"a": {"100": "x"}}),
        ("a[]=b&a[t]=u", {"a": {"0": "b", "t": "u"}}),
        ("a=1&a=2", {"a": ["1", "2"]}),
        ("a[b][c][d][e][f][g][h]=i", {"a": {"b": {"c": {"d": {"e": {"f": {"[g][h]": "i"}}}}}}}),
        ("a%5Bb%5D=c+d%20e", {"a": {"b": "c d e"}}),
        ("a[]=b&a[]=c&a=d", {"a": ["b", "c", "d"]}),
        ("a=d&a[]=b", {"a": ["d", "b"]}),
        ("a=b&a[c]=d", {"a": ["b", {"c": "d"}]}),
        ("a[b]=c&a=d", {"a": {"b": "c", "d": True}}),
        ("a[0][b]=1&a[0][c]=2&a[1][b]=3", {"a": [{"b": "1", "c": "2"}, {"b": "3"}]}),
        ("&&=x&%ff=%ff", {"%ff": "%ff"}),
        ("", {}),
    ],
)
def test_nested(query, want):
    assert N.parse(query) == want


def test_nested_options():
    assert N.parse("a.b=c", allow_dots=True) == {"a": {"b": "c"}}
    assert N.parse("a=b,c", comma=True) == {"a": ["b", "c"]}
    assert N.parse("a;b=c", delimiter=";", strict_nulls=True) == {"a": None, "b": "c"}
    value = {"a": ["b", "c"], "d": {"e": "f g", "h": None}}
    assert N.stringify(value, encode=False) == "a[0]=b&a[1]=c&d[e]=f g&d[h]="
    assert N.stringify(value, arrays="repeat", allow_dots=True) == "a=b&a=c&d.e=f%20g&d.h="
    assert N.stringify(value, arrays="comma", encode=False, delimiter=";") == "a=b,c;d[e]=f g;d[h]="
    assert N.parse(N.stringify(value)) == {"a": ["b", "c"], "d": {"e": "f g", "h": ""}}


def test_deep_markup():
    deep = "<div>" * 30000 + "x"
    assert M.to_markdown(deep) == "x"
    assert len(H.node_rows(deep)) == 30001


def test_columns(spark):
    df = spark.createDataFrame([(1, "<p>a<b>b"), (2, None), (3, "")], "i int, h string")
    got = df.select("i", C.text("h").alias("t"), C.markdown("h").alias("m"), C.sanitized("h").alias("s")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "ab", "a**b**", "<p>a<b>b</b></p>"), (2, None, None, None), (3, "", "", "")]
    rows = C.node_table(df, "h", "i").orderBy("i", "node_id").collect()
    assert [(r.i, r.node_id, r.parent_id, r.depth, r.pos, r.kind, r.name, r.data) for r in rows] == [(1, 1, 0, 1, 0, "tag", "p", ""), (1, 2, 1, 2, 0, "text", "", "a"), (1, 3, 1, 2, 1, "tag", "b", ""), (1, 4, 3, 3, 0, "text", "", "b")]
    q = spark.createDataFrame([("a[b]=c",), (None,)], "q string").select(C.query_json("q").alias("j")).select("j", C.query_of_json("j").alias("back"))
    assert [tuple(r) for r in q.collect()] == [('{"a":{"b":"c"}}', "a%5Bb%5D=c"), (None, None)]
