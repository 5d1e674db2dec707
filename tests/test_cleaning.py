"""Options of sanitising, and of Markdown from markup."""

import re

import pytest

from docloom.core import html as H
from docloom.core import markdown as M
from docloom.functions import html as C


@pytest.mark.parametrize(
    "markup, options, want",
    [
        ("<my-tag x-y=1 z=2>t</my-tag>", {}, "t"),
        ("<my-tag x-y=1 z=2>t</my-tag>", {"custom_tags": "^my-", "custom_attributes": lambda name, tag: name == "z"}, '<my-tag z="2">t</my-tag>'),
        ("<annotation-xml>t</annotation-xml>", {}, "t"),
        ("<form action=/x><b>t</b></form>", {"add_tags": ("form",), "add_attributes": ("action",)}, '<form action="/x"><b>t</b></form>'),
        ("<form action=javascript:x>t</form>", {"add_tags": ("form",), "add_attributes": ("action",)}, "<form>t</form>"),
        ("<b>x</b><i>y</i>", {"forbid_tags": ("b",)}, "x<i>y</i>"),
        ("<b>x</b><i>y</i>", {"forbid_tags": ("b",), "add_gone_with_content": ("b",)}, "<i>y</i>"),
        ("<b>x</b><who>y</who>", {"keep_content": False}, "<b>x</b>"),
        ("<b class=c title=t>x</b>", {"forbid_attributes": ("class",)}, '<b title="t">x</b>'),
        ("<b data-a=1 aria-b=2>x</b>", {"data_attributes": False}, '<b aria-b="2">x</b>'),
        ("<b data-a=1 aria-b=2>x</b>", {"aria_attributes": False}, '<b data-a="1">x</b>'),
        ("<a href=foo:x>x</a>", {}, "<a>x</a>"),
        ("<a href=foo:x>x</a><a href=vbscript:x>y</a>", {"unknown_schemes": True}, '<a href="foo:x">x</a><a>y</a>'),
        ("<a href=foo:x>x</a><a href=http:x>y</a>", {"address": re.compile("foo:")}, '<a href="foo:x">x</a><a>y</a>'),
        ("<a href=xmpp:x>x</a><img src=data:image/png;base64,aa><a href=data:x>y</a>", {}, '<a href="xmpp:x">x</a><img src="data:image/png;base64,aa"><a>y</a>'),
        ("<img srcset='a.png 1x, javascript:x 2x, b.png 3x'>", {"add_attributes": ("srcset",)}, '<img srcset="a.png 1x, b.png 3x">'),
        ("<b id=cookie name=x>x</b>", {}, '<b name="x">x</b>'),
        ("<b id=cookie>x</b>", {"clobbering": True}, '<b id="cookie">x</b>'),
        ("<b id=cookie name=user-x>x</b>", {"prefix": "user-"}, '<b id="user-cookie" name="user-x">x</b>'),
        ("<b title='a ${b}'>x {{y}} z</b>", {"templates": True}, '<b title="a  ">  z</b>'),
        ("<b title='</style>'>x</b>", {}, "<b>x</b>"),
        ("<b title='</style>'>x</b>", {"markup_in_values": True}, '<b title="&lt;/style&gt;">x</b>'),
        ("<b title='a/>'>x</b>", {"self_closing_values": False}, "<b>x</b>"),
        ("<style>a{}</style><style><img></style>", {"add_tags": ("style",)}, "<style>a{}</style>"),
        ("<script>x</script><b onclick=y srcdoc=z>t</b>", {"add_tags": ("script",), "add_attributes": ("onclick", "srcdoc")}, "<b>t</b>"),
        ("<b title=x>t</b><i title=y>u</i>", {"on_element": lambda name, attrs: name != "i", "on_attribute": lambda tag, name, value: value.upper()}, '<b title="X">t</b>u'),
        ("", {}, ""),
    ],
)
def test_policy(markup, options, want):
    assert H.sanitize(markup, **options) == want


@pytest.mark.parametrize("markup", ["<a href='java&#10;script:x'>", "<a href='&#x6A;avascript:x'>", "<img src=x onerror=y>", "<style><img src=x onerror=y></style>", "<a href='\x01javascript:x'>", "<img srcset='javascript:x 1x'>"])
def test_nothing_runs_under_wide_options(markup):
    clean = H.sanitize(markup, add_tags=("style",), add_attributes=("srcset", "onerror"), unknown_schemes=True)
    assert "script" not in clean and "onerror" not in clean


def test_columns(spark):
    df = spark.createDataFrame([(1, "<b onclick=x>t</b><script>y</script>"), (2, None), (3, "")], "i int, h string")
    got = [r.s for r in df.select("i", C.sanitized_with_removed("h").alias("s")).orderBy("i").collect()]
    assert got[0].html == "<b>t</b>" and [tuple(x) for x in got[0].removed] == [("b", "onclick"), ("script", None)]
    assert got[1] is None and got[2].html == "" and got[2].removed == []
    df = spark.createDataFrame([("A", "HREF", "/x"), ("a", "href", "javascript:x"), ("a", "onclick", ""), (None, "href", "/x")], "e string, a string, v string")
    assert [r.ok for r in df.select(C.attribute_allowed("e", "a", "v").alias("ok")).collect()] == [True, False, False, None]


@pytest.mark.parametrize(
    "style, want",
    [
        ("full", '[one][1] [two][2]\n\n[1]: /a\\(b\\) "T"\n[2]: /c'),
        ("collapsed", '[one][] [two][]\n\n[one]: /a\\(b\\) "T"\n[two]: /c'),
        ("shortcut", '[one] [two]\n\n[one]: /a\\(b\\) "T"\n[two]: /c'),
    ],
)
def test_references(style, want):
    assert M.to_markdown('<a href="/a(b)" title="T">one</a> <a href="/c">two</a>', link_style="referenced", link_reference_style=style) == want


def test_kept_elements_rules_and_highlighted_code():
    assert M.to_markdown("<p>a <ins>b</ins></p><video src=x></video>", keep=("ins", "video")) == 'a <ins>b</ins>\n\n<video src="x"></video>'
    assert M.to_markdown("<p>a <u class=c>b</u> <em>d</em></p>", rules={"u": lambda content, attrs: f"{attrs['class']}:{content}", "em": lambda content, attrs: content.upper()}) == "a c:b D"
    markup = '<div class="highlight highlight-source-py"><pre>x = <b>1</b></pre></div>'
    assert M.to_markdown(markup, gfm=True) == "```py\nx = 1\n```"
    assert M.to_markdown(markup) == "x = **1**"


@pytest.mark.parametrize("blank", [0x1680, 0x180E, 0x2000, 0x2028, 0x2029, 0x205F, 0x3000, 0xA0])
def test_wide_blanks_do_not_hide_a_scheme(blank):
    assert H.sanitize(f"<a href='java{chr(blank)}script:x'>t</a>") == "<a>t</a>"
