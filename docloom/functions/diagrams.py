"""Diagrams written as text, as columns and rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.core import diagrams as D
from docloom.functions.html import _mapped, _rows

ELEMENT = "struct<place:int,kind:string,name:string,text:string,source:string,target:string,style:string,value:double,parent:string>"
_ELEMENT = pa.struct([("place", pa.int32()), *((n, pa.string()) for n in ("kind", "name", "text", "source", "target", "style")), ("value", pa.float64()), ("parent", pa.string())])
_SAID = ("type", "title", "acc_title", "acc_description", "direction", "error")
DIAGRAM = "struct<" + ",".join(f"{n}:string" for n in _SAID) + f",elements:array<{ELEMENT}>>"
_DIAGRAM = pa.struct([*((n, pa.string()) for n in _SAID), ("elements", pa.list_(_ELEMENT))])


def diagram_type(text: Column | str) -> Column:
    """flowchart, sequence, pie or timeline by the first line that says something; null for other texts. Native."""
    c = F.col(text) if isinstance(text, str) else text
    word = F.regexp_extract(c, r"\A(?:[ \t]*(?:(?:%%|#)[^\r\n]*)?(?:\r\n?|\n))*[ \t]*([^\s]+)", 1)
    return F.create_map(*[F.lit(x) for pair in D.TYPES.items() for x in pair])[word]


def diagram(text: Column | str) -> Column:
    """The diagram as a DIAGRAM struct, see docloom.core.diagrams.parse; null gives null."""
    return _mapped(D.parse, text, DIAGRAM, _DIAGRAM)


def diagram_elements(table: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each element of each diagram, beside the columns to keep; texts that are no diagrams have no rows. No shuffle."""
    return _rows(table, text, keep, lambda x: D.parse(x)["elements"], ELEMENT, _ELEMENT)
