"""Options of nested query strings, both ways."""

import re

import pytest

from docloom.core import nested as N
from docloom.functions import html as C


@pytest.mark.parametrize(
    "query, options, want",
    [
        ("a=1&a=2&b=3", {"duplicates": "first"}, {"a": "1", "b": "3"}),
        ("a=1&a=2&b=3", {"duplicates": "last"}, {"a": "2", "b": "3"}),
        ("a[]=1&a[]=2", {"duplicates": "last"}, {"a": ["1", "2"]}),
        ("a[19]=x", {}, {"a": ["x"]}),
        ("a[20]=x", {}, {"a": {"20": "x"}}),
        ("a=1&a=2&a=3", {"array_limit": 2}, {"a": {"0": "1", "1": "2", "2": "3"}}),
        ("a[]=1", {"array_limit": 0}, {"a": {"0": "1"}}),
        ("a[0]=b&a[]=c", {"arrays": False}, {"a": {"0": ["b", "c"]}}),
        ("a=b&a=c", {"arrays": False}, {"a": ["b", "c"]}),
        ("a[]=&b=c", {"empty_arrays": True}, {"a": [], "b": "c"}),
        ("a[]=&b=c", {}, {"a": [""], "b": "c"}),
        ("a[]", {"empty_arrays": True, "strict_nulls": True}, {"a": []}),
        ("a[toString]=x&b=c&hasOwnProperty=y&__proto__[z]=1&a[__proto__]=2", {}, {"b": "c"}),
        ("a[toString]=x&__proto__=1", {"prototypes": True}, {"a": {"toString": "x"}}),
        ("n%252Eo.first=x", {"decode_dots": True}, {"n.o": {"first": "x"}}),
        ("a%5Bb%5D=c", {}, {"a": {"b": "c"}}),
        ("a=%e4", {"charset": "iso-8859-1"}, {"a": "ä"}),
        ("a=%e4", {}, {"a": "%e4"}),
        ("utf8=%26%2310003%3B&a=%e4", {"sentinel": True}, {"a": "ä"}),
        ("utf8=%E2%9C%93&a=%C3%A4", {"sentinel": True, "charset": "iso-8859-1"}, {"a": "ä"}),
        ("a=%26%239786%3B", {"charset": "iso-8859-1", "entities": True}, {"a": "☺"}),
        ("a=%26%239786%3B", {"entities": True}, {"a": "&#9786;"}),
        ("a=1;b=2,c=3", {"delimiter": re.compile("[;,]")}, {"a": "1", "b": "2", "c": "3"}),
        ("", {}, {}),
    ],
)
def test_parse(query, options, want):
    assert N.parse(query, **options) == want


@pytest.mark.parametrize("query, options", [("a[b][c]=d", {"depth": 1, "strict_depth": True}), ("a=1&a=2", {"array_limit": 1, "strict_limits": True}), ("a=1&b=2", {"parameter_limit": 1, "strict_limits": True})])
def test_strict(query, options):
    with pytest.raises(ValueError):
        N.parse(query, **options)


@pytest.mark.parametrize(
    "value, options, want",
    [
        ({"b": 1, "a": {"d": 2, "c": 3}}, {"sort": True, "encode": False}, "a[c]=3&a[d]=2&b=1"),
        ({"a": 1, "b": [1, 2], "c": {"a": 3}}, {"keys": ("c", "b", "a", "0"), "encode": False}, "c[a]=3&b[0]=1&a=1"),
        ({"a": None, "b": {"c": None, "d": ""}}, {"skip_nulls": True, "encode": False}, "b[d]="),
        ({"a": None, "b": {"c": None}}, {"strict_nulls": True, "encode": False}, "a&b[c]"),
        ({"a": [], "b": "c"}, {"empty_arrays": True}, "a[]&b=c"),
        ({"a.b": {"c.d": 1}}, {"encode_dots": True, "allow_dots": True, "encode": False}, "a%2Eb.c%2Ed=1"),
        ({"a": [" "], "b[": "ä"}, {"values_only": True}, "a[0]=%20&b[=%C3%A4"),
        ({"a": ["b"]}, {"arrays": "comma", "comma_round_trip": True, "encode": False}, "a[]=b"),
        ({"a": ["b,c", "d"]}, {"arrays": "comma", "values_only": True}, "a=b%2Cc,d"),
        ({"a": ["b,c", "d"]}, {"arrays": "comma"}, "a=b%2Cc%2Cd"),
        ({"a": "ä☺ +"}, {"charset": "iso-8859-1"}, "a=%E4%26%239786%3B%20+"),
        ({"a": "x"}, {"sentinel": True, "prefix": True}, "?utf8=%E2%9C%93&a=x"),
        ({}, {"prefix": True}, ""),
        ({"a": True, "b": 1.5}, {}, "a=true&b=1.5"),
    ],
)
def test_stringify(value, options, want):
    assert N.stringify(value, **options) == want


def test_deep_values_and_columns(spark):
    value = "x"
    for _ in range(20000):
        value = [value]
    assert N.stringify({"a": value}, arrays="repeat") == "a=x"
    with pytest.raises(ValueError):
        N.stringify({"a": {"b": {"c": 1}}}, depth=1)
    df = spark.createDataFrame([(1, "a[b][c]=1"), (2, "a=1"), (3, None), (4, "")], "i int, q string")
    got = df.select("i", C.query_json("q", depth=1, strict_depth=True).alias("j")).orderBy("i").collect()
    assert [r.j for r in got] == [None, '{"a":"1"}', None, "{}"]
