"""Codes, scripts' functions, files and walks of graphs: cases by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docloom.catalogue import _checkpoints
from docloom.core import graphs
from docloom.functions import codes as D
from docloom.functions import script as S
from docloom.functions import validate as V
from docloom.operators.graph import Graph
from docloom.plans.layout import layout
from docloom.sources import files


def ask(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows)]


CASES = [
    (lambda: D.is_iban("value"), ["DE89 3704 0044 0532 0130 00", "gb29-nwbk-6016-1331-9268-19", "NO9386011117947"], ["DE89370400440532013001", "XX89370400440532013000", "DE", ""]),
    (lambda: D.is_iban("value", countries=["NO"]), ["NO9386011117947"], ["DE89370400440532013000"]),
    (lambda: D.is_iban("value", without=["NO"]), ["DE89370400440532013000"], ["NO9386011117947"]),
    (lambda: D.is_iban("value", countries=["ZZ"]), [], ["NO9386011117947"]),
    (lambda: D.is_currency("value"), ["$1,234.50", "-$1", "0", "$.50", "1234", "10,123"], ["$", "1.234", "$1,23", "- $1", "1.2", "a"]),
    (lambda: D.is_currency("value", symbol="€", thousands=".", point=",", space_after_symbol=True, require_symbol=True), ["€ 1.234,50", "€1"], ["1.234,50", "€1,234.50"]),
    (lambda: D.is_currency("value", parens=True), ["($1.00)", "$1.00"], ["-$1.00", "($1"]),
    (lambda: D.is_currency("value", sign_after_digits=True, symbol_after_digits=True), ["1.00-$", "1.00"], ["-1.00"]),
    (lambda: D.is_currency("value", negatives=False, require_decimal=True, digits=(1, 2)), ["1.5", "1.50"], ["1", "-1.50"]),
    (lambda: D.is_mailto_uri("value"), ["mailto:", "mailto:a@b.co,c@d.co?subject=x&cc=e@f.org", "mailto:?cc=a@b.co"], ["mail:a@b.co", "mailto:a", "mailto:a@b.co?x=1", "mailto:a@b.co?cc=q", "mailto:?cc=a@b.co&cc=c@d.co"]),
    (lambda: D.is_iso31661_alpha2("value"), ["DE", "US"], ["de", "XX", ""]),
    (lambda: D.is_iso31661_alpha3("value"), ["DEU", "USA"], ["deu", "XXX"]),
    (lambda: D.is_iso31661_numeric("value", ["276", "840"]), ["276"], ["277"]),
    (lambda: D.is_iso4217("value"), ["EUR", "usd"], ["EURO", "QQQ"]),
    (lambda: D.is_iso6391("value"), ["de", "en"], ["DE", "xx"]),
    (lambda: D.is_iso15924("value", ["Latn", "Cyrl"]), ["Latn"], ["latn"]),
    (lambda: V.is_alpha("value", "tr-TR"), ["AİıŞ"], ["a1"]), (lambda: V.is_alpha("value", "en-GB"), ["abc"], ["é"]), (lambda: V.is_alpha("value", "pt-BR"), ["palíndromo"], ["12", "æ"]),
    (lambda: V.is_alpha("value", "ar-EG"), ["سلام"], ["abc"]), (lambda: V.is_alphanumeric("value", "ar"), ["سلام٣1"], ["abc"]), (lambda: V.is_alphanumeric("value", "ta-IN"), ["தமிழ்1"], ["x"]),
    (lambda: V.is_decimal("value", "ar"), ["0٫1", "1"], ["0.1", "0,1"]), (lambda: V.is_numeric("value", locale="fr-FR"), ["0,1"], ["0.1"]), (lambda: V.is_float("value", "en-GB"), ["1.5e3"], ["1,5", "1e", "e", "-e", "5e+"]),
]


@pytest.mark.parametrize("column, good, bad", CASES)
def test_predicates(spark, column, good, bad):
    spark.range(1).count()
    got = ask(spark, column(), [*good, *bad, None])
    assert got == [True] * len(good) + [False] * len(bad) + [None]


def test_normalized_email(spark):
    given = ["Some.Name+x@GoogleMail.com", "A.B@Example.COM", "no", "+x@gmail.com", "a@b@C.org", None]
    assert ask(spark, D.normalized_email("value"), given) == ["somename@gmail.com", "a.b@example.com", None, None, "a@b@c.org", None]
    assert ask(spark, D.normalized_email("value", gmail_remove_dots=False, gmail_convert_googlemail=False, gmail_remove_subaddress=False, all_lowercase=False), given[:2]) == ["some.name+x@googlemail.com", "A.B@example.com"]


def test_strings(spark):
    s = "héllo wörld"
    want = [
        (S.char_at("value", 1), s[1]), (S.char_at("value", -1), ""), (S.char_code_at("value", 1), ord("é")), (S.char_code_at("value", 99), None), (S.index_of("value", "o"), 4), (S.index_of("value", "z"), -1), (S.last_index_of("value", "l"), 9),
        (S.sliced("value", -5, -1), s[-5:-1]), (S.sliced("value", 3), s[3:]), (S.sliced("value", 5, 2), ""), (S.substring("value", 5, 2), s[2:5]), (S.split("value", " "), s.split(" ")), (F.size(S.split("value", "")), 11),
        (S.replaced("value", "l", "L"), s.replace("l", "L", 1)), (S.replaced_all("value", "l", "L"), s.replace("l", "L")), (S.padded_start("value", 13, "ab"), "ab" + s), (S.padded_end("value", 5, "x"), s), (S.repeated("value", 2), s * 2),
        (S.starts_with("value", "llo", 2), True), (S.ends_with("value", "ld"), True), (S.includes("value", "ö"), True), (S.upper("value"), s.upper()), (S.trimmed(F.lit("\u00a0 a\t")), "a"),
    ]
    row = spark.createDataFrame([(s,)], "value string").select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(want)]).first()
    assert list(row) == [w for _, w in want]


def test_numbers_arrays_objects(spark):
    a = F.array(*[F.lit(x) for x in (3, 10, 1)])
    entries = F.array(F.struct(F.lit("a").alias("k"), F.lit(1).alias("v")))
    want = [
        (S.to_radix(F.lit(-255), 16), "-ff"), (S.to_fixed(F.lit(1.005), 1), "1.0"), (S.to_fixed(F.lit(-2.5), 0), "-3"), (S.math("round", F.lit(-2.5)), -2), (S.math("trunc", F.lit(-2.5)), -2), (S.math("hypot", F.lit(3.0), F.lit(4.0)), 5.0),
        (S.array_sorted(a), [1, 10, 3]), (S.array_reversed(a), [1, 10, 3]), (S.array_slice(a, -2), [10, 1]), (S.array_splice(a, 1, 1, F.lit(7), F.lit(8)), [3, 7, 8, 1]), (S.array_index_of(a, F.lit(10)), 1), (S.array_find(a, lambda x: x > 99), None),
        (S.array_find_index(a, lambda x: x < 3), 2), (S.array_find_index(a, lambda x: x < 0), -1), (S.array_joined(a), "3,10,1"), (S.array_pushed(a, F.lit(5)), [3, 10, 1, 5]), (S.array_unshifted(a, F.lit(5)), [5, 3, 10, 1]),
        (S.array_filled(a, F.lit(0), 1), [3, 0, 0]), (S.array_map(a, lambda x: x * 2), [6, 20, 2]), (S.array_filter(a, lambda x: x > 2), [3, 10]), (S.array_reduce(a, lambda s, x: s + x, F.lit(0)), 14), (S.array_every(a, lambda x: x > 0), True),
        (S.object_from_entries(entries), {"a": 1}), (S.object_assigned(S.object_from_entries(entries), F.create_map(F.lit("a"), F.lit(2))), {"a": 2}), (S.json_type(F.lit("[1]")), "array"), (S.json_type(F.lit("{")), None), (S.json_type(F.lit("1.5")), "number"),
        (S.json_of(S.object_from_entries(entries)), '{"a":1}'), (S.json_parsed(F.lit('{"x": [1]}'), "struct<x:array<int>>")["x"], [1]),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(want)]).first()
    assert list(row) == [w for _, w in want]


def test_files(spark, tmp_path):
    at = str(tmp_path / "t")
    assert files.list_files(spark, at).count() == 0
    assert files.load_text(spark, at, "none").first().text == "none"
    assert files.load_json(spark, at, "a int").count() == 0
    rows = spark.createDataFrame([(2, "ä\u2028b"), (1, None)], "b int, text string").repartition(1)
    files.save_json(rows, files.save_text(rows, at) + "/../j")
    assert sorted(r.text for r in files.read_texts(spark, at, "*.txt").collect()) == ["ä\u2028b\n\n"]
    assert sorted((r.b, r.text) for r in files.load_json(spark, str(tmp_path / "j"), "b int, text string").collect()) == [(1, None), (2, "ä\u2028b")]
    (tmp_path / "one.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sorted(r.a for r in files.load_json(spark, str(tmp_path / "one.json"), "a int").collect()) == [1, 2]
    assert [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), "*.json").collect()] == ["one.json"]


def random_graph(rnd, n, m):
    return list(range(n)), [(rnd.randrange(n), rnd.randrange(n), float(rnd.randint(1, 3))) for _ in range(m)]


def test_graph_kernels():
    rnd = random.Random(3)
    for _ in range(200):
        nodes, edges = random_graph(rnd, rnd.randint(1, 7), rnd.randint(0, 12))
        for cut in (graphs.back_edges(nodes, edges), graphs.greedy_cut(nodes, edges)):
            turned = [(w, v, x) if i in cut else (v, w, x) for i, (v, w, x) in enumerate(edges) if v != w]
            order = graphs.sorted_topologically(nodes, turned)
            assert order is not None and sorted(order) == nodes
            place = {v: i for i, v in enumerate(order)}
            assert all(place[v] < place[w] for v, w, _ in turned)
            rank = graphs.layers(nodes, turned)
            tight, tree = graphs.tight_tree(nodes, turned, rank)
            assert all(tight[w] - tight[v] >= 1 for v, w, _ in turned) and all(tight[turned[i][1]] - tight[turned[i][0]] == 1 for i in tree)
            spot = graphs.ordered_layers(tight, turned)
            pairs = [(a, b) for a, b in itertools.combinations([e for e in turned if tight[e[1]] == tight[e[0]] + 1], 2) if tight[a[0]] == tight[b[0]]]
            brute = sum(a[2] * b[2] for a, b in pairs if (spot[a[0]] - spot[b[0]]) * (spot[a[1]] - spot[b[1]]) < 0)
            assert graphs.crossing_count(spot, tight, turned) == brute
        cyclic = any(graphs.sorted_topologically(nodes, edges) is None for _ in [0])
        assert cyclic == bool(graphs.back_edges(nodes, edges))
    chain = [(i, i + 1, 1.0) for i in range(30000)]
    assert graphs.sorted_topologically(list(range(30001)), chain) == list(range(30001))
    assert graphs.walked(graphs.neighbours([1, 2, 3], [(1, 2, 1), (2, 3, 1)]), [1], True) == [3, 2, 1]


def test_graph_tables(spark):
    _checkpoints(spark)
    nodes = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "d", "c"), (2, "x", None)], "graph_id int, v string, parent string")
    edges = spark.createDataFrame([(1, "a", "b", None), (1, "b", "c", None), (1, "c", "a", None), (1, "d", "d", None)], "graph_id int, v string, w string, name string")
    g = Graph(nodes, edges)
    assert {(r.v, r.parent) for r in g.filter_nodes("v in ('a', 'd')").nodes.collect()} == {("a", None), ("d", "a")}
    assert {(r.v, r.parent) for r in g.filter_nodes("v in ('d', 'x')").nodes.collect()} == {("d", None), ("x", None)}
    assert sorted((r.graph_id, r.cyclic) for r in g.topological_order().collect()) == [(1, True), (2, False)]
    again = g.acyclic()
    assert again.edges.filter("reversed").count() == 1 and again.topological_order().filter("cyclic").count() == 0
    assert [r.v for r in g.walked({1: ["b"], 2: []}).orderBy("place").collect()] == ["b", "c", "a"]
    moved = g.set_parents(spark.createDataFrame([(1, "b", None), (1, "a", "b")], "graph_id int, v string, parent string"))
    assert {(r.v, r.parent) for r in moved.nodes.collect()} == {("a", "b"), ("b", None), ("c", "b"), ("d", "c"), ("x", None)}
    with pytest.raises(ValueError):
        g.set_parents(spark.createDataFrame([(1, "a", "d")], "graph_id int, v string, parent string"))
    drawn = layout(g).collect()
    assert {r.v for r in drawn} == {"a", "b", "c", "d", "x"}
    layer = {r.v: r.layer for r in drawn}
    assert layer["a"] < layer["b"] < layer["c"]
