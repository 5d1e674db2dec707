"""Diagrams: hand-written cases for each kind."""

import pytest

from docloom.core import diagrams as D
from docloom.functions import diagrams as C


def _of(text, *kinds):
    return [r for r in D.parse(text)["elements"] if r["kind"] in kinds]


def test_types(spark):
    texts = ["%% c\n\nsequenceDiagram\nA->>B: x", "pie\n", "  timeline", "graph TD", "flowchart LR;A", "hello", "", "# x\n%% y", "graphs"]
    want = ["sequence", "pie", "timeline", "flowchart", "flowchart", None, None, None, None]
    assert [D.kind_of(x) for x in texts] == want
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "i int, t string")
    assert [r.k for r in df.select("i", C.diagram_type("t").alias("k")).orderBy("i").collect()] == [*want, None]


@pytest.mark.parametrize(
    "node, want",
    [("A", ("A", "round")), ("A[x]", ("x", "square")), ("A(x)", ("x", "round")), ("A((x))", ("x", "circle")), ("A(((x)))", ("x", "doublecircle")), ("A([x])", ("x", "stadium")), ("A[[x]]", ("x", "subroutine")), ("A[(x)]", ("x", "cylinder")),
     ("A{x}", ("x", "diamond")), ("A{{x}}", ("x", "hexagon")), ("A>x]", ("x", "odd")), ("A[/x/]", ("x", "lean_right")), ("A[\\x\\]", ("x", "lean_left")), ("A[/x\\]", ("x", "trapezoid")), ("A[\\x/]", ("x", "inv_trapezoid")), ('A["x [y]"]', ("x [y]", "square")), ("A[ x ]", ("x", "square"))],
)
def test_shapes(node, want):
    (got,) = _of(f"graph TD\n{node}", "node")
    assert (got["text"], got["style"]) == want


@pytest.mark.parametrize(
    "arrow, style, length, text",
    [("-->", "normal arrow_point", 1, ""), ("---", "normal arrow_open", 2, ""), ("---->", "normal arrow_point", 3, ""), ("-.->", "dotted arrow_point", 1, ""), ("-..->", "dotted arrow_point", 2, ""), ("==>", "thick arrow_point", 1, ""), ("===", "thick arrow_open", 2, ""),
     ("--x", "normal arrow_cross", 1, ""), ("--o", "normal arrow_circle", 1, ""), ("<-->", "normal double_arrow_point", 1, ""), ("x--x", "normal double_arrow_cross", 1, ""), ("~~~", "invisible arrow_open", 1, ""), ("-->|yes|", "normal arrow_point", 1, "yes"), ("-- a b -->", "normal arrow_point", 1, "a b"), ("-. c .->", "dotted arrow_point", 1, "c"), ("== d ==>", "thick arrow_point", 1, "d")],
)
def test_arrows(arrow, style, length, text):
    (got,) = _of(f"graph TD\nA {arrow} B", "edge")
    assert (got["source"], got["target"], got["style"], got["value"], got["text"]) == ("A", "B", style, length, text)


def test_flowchart():
    text = "%% c\nflowchart LR\n title T\nA[x]-->B & C-->D; style A fill:#f\nsubgraph one [First]\n direction TB\n E-->A\n subgraph\n F\n end\nend\nA(y)\n"
    got = D.parse(text)
    assert (got["type"], got["title"], got["direction"], got["error"]) == ("flowchart", "T", "LR", None)
    assert [(r["source"], r["target"]) for r in _of(text, "edge")] == [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("E", "A")]
    assert {r["name"]: (r["text"], r["parent"]) for r in _of(text, "node")} == {"A": ("y", "one"), "B": ("B", None), "C": ("C", None), "D": ("D", None), "E": ("E", "one"), "F": ("F", "subGraph1")}
    assert [(r["name"], r["text"], r["parent"], r["style"]) for r in _of(text, "group")] == [("one", "First", None, "TB"), ("subGraph1", "subGraph1", "one", None)]


def test_sequence():
    text = """sequenceDiagram
    title: T
    autonumber 5 10
    box Aqua Group
      participant A as Alice
      actor B
    end
    A->>+B: wrap: hi; B-->>-A: ho
    alt good
      A-xB: x
      loop each
        Note over A,B: n
      end
    else bad
      A-)B: y
    end
    create participant C
    B->>C: new
    destroy C
    C--xB: bye
    link A: Site @ https://x.y
    links B: {"L": "/z"}
    properties B: not json
    """
    got = D.parse(text)
    assert (got["title"], got["error"]) == ("T", None)
    assert [(r["name"], r["text"], r["style"], r["parent"], r["value"]) for r in _of(text, "actor")] == [("A", "Alice", "participant", "box1", None), ("B", "B", "actor", "box1", None), ("C", "C", "participant", None, 1.0)]
    assert [(r["source"], r["target"], r["text"], r["value"], r["parent"]) for r in _of(text, "message")] == [("A", "B", "hi", 0, None), ("B", "A", "ho", 1, None), ("A", "B", "x", 3, "alt2"), ("A", "B", "y", 24, "alt2"), ("B", "C", "new", 0, None), ("C", "B", "bye", 4, None)]
    assert [(r["kind"], r["name"], r["style"], r["parent"]) for r in _of(text, "block", "section", "block_end")] == [("block", "alt2", "alt", None), ("block", "loop3", "loop", "alt2"), ("block_end", "loop3", "loop", "alt2"), ("section", "alt2", "else", "alt2"), ("block_end", "alt2", "alt", None)]
    assert [(r["kind"], r["name"]) for r in _of(text, "activation", "deactivation")] == [("activation", "B"), ("deactivation", "B")]
    assert [(r["source"], r["target"], r["text"], r["style"], r["parent"]) for r in _of(text, "note")] == [("A", "B", "n", "over", "loop3")]
    assert [(r["name"], r["text"], r["parent"]) for r in _of(text, "link", "property")] == [("Site", "https://x.y", "A"), ("L", "/z", "B")]
    assert [(r["text"], r["style"]) for r in _of(text, "box")] == [("Group", "Aqua")] and [r["text"] for r in _of(text, "numbering")] == ["5 10"]


@pytest.mark.parametrize("line", ["hello", "A->>-B: x", "deactivate A", "loop x", "end", "else x", "Note by A: x", "create participant C\nA->>B: x", "A->>B: x\ncreate participant B", "autonumber x", "links A: {}"])
def test_bad_sequences(line):
    got = D.parse(f"sequenceDiagram\n{line}")
    assert got["error"] and got["elements"] == []


def test_pie_and_timeline():
    text = 'pie showData title P\n"a" : 1\n%% c\n"a" : 2\n"b \\"c" : 2.5\naccDescr { one\ntwo }\naccTitle: t'
    got = D.parse(text)
    assert (got["title"], got["acc_title"], got["acc_description"]) == ("P", "t", "one\ntwo")
    assert [(r["name"], r["value"]) for r in _of(text, "slice")] == [("a", 1.0), ('b "c', 2.5)] and len(_of(text, "show_data")) == 1
    assert all(D.parse(f"pie\n{x}")["error"] for x in ('"a" : -1', "a : 1", '"__proto__" : 1'))
    text = "timeline\ntitle T\n2001 : a : b\n: c\nsection S\n12:30 : d\n2002"
    assert [(r["kind"], r["name"], r["text"], r["parent"]) for r in D.parse(text)["elements"]] == [
        ("task", "0", "2001", None), ("event", None, "a", "0"), ("event", None, "b", "0"), ("event", None, "c", "0"), ("section", "S", "S", None), ("task", "1", "12:30", "S"), ("event", None, "d", "1"), ("task", "2", "2002", "S"),
    ]


def test_deep_blocks_and_columns(spark):
    deep = "sequenceDiagram\n" + "loop x\n" * 5000 + "A->>B: m\n" + "end\n" * 5000
    assert len(_of(deep, "block")) == 5000
    df = spark.createDataFrame([(1, "pie\n\"a\": 1"), (2, None), (3, ""), (4, "pie\nx")], "i int, t string")
    got = [r.d for r in df.select("i", C.diagram("t").alias("d")).orderBy("i").collect()]
    assert got[0].elements[0].name == "a" and got[1] is None and got[2].error == "no diagram" and got[3].elements == []
    rows = C.diagram_elements(df, "t", "i").collect()
    assert [(r.i, r.kind, r.name, r.value) for r in rows] == [(1, "slice", "a", 1.0)]
