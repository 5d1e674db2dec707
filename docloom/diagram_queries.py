"""Queries over diagrams that are written from the rows of whole tables, with SQL that knows the rows they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.catalogue import _read, query
from docloom.functions import diagrams as G
from docloom.functions import html as H


def _text(*parts: Column | str) -> Column:
    """Parts one after another; plain strings are texts."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


_KINDS = ["sequenceDiagram", "pie title x", "timeline", "graph TD", "flowchart LR", "graphs", "%% only"]


@query("""SELECT doc_id, CASE word WHEN 'sequenceDiagram' THEN 'sequence' WHEN 'pie' THEN 'pie' WHEN 'timeline' THEN 'timeline' WHEN 'graph' THEN 'flowchart' WHEN 'flowchart' THEN 'flowchart' END AS kind FROM (
  SELECT doc_id, regexp_extract(list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12))), lambda x: x <> '' AND NOT starts_with(x, '%%') AND NOT starts_with(x, '#'))[1], '^\\S+') AS word
  FROM (SELECT doc_id, '%% c' || chr(10) || ' ' || chr(10) || ['sequenceDiagram', 'pie title x', 'timeline', 'graph TD', 'flowchart LR', 'graphs', '%% only'][1 + doc_id % 7] || chr(10) || coalesce(text, '') AS t FROM documents))""")
def diagram_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of documents under a first line of each kind, after comments."""
    first = F.array(*[F.lit(x) for x in _KINDS])[(F.col("doc_id") % len(_KINDS)).cast("int")]
    return _read(spark, sf_dir, "documents").select("doc_id", G.diagram_type(_text("%% c\n \n", first, "\n", F.coalesce("text", F.lit("")))).alias("kind"))


@query("""SELECT c_custkey, place::INTEGER AS place, kind, name, value::DOUBLE AS value, title FROM (
  SELECT c_custkey, 0 AS place, 'show_data' AS kind, NULL AS name, NULL AS value, c_name AS title FROM customer UNION ALL SELECT c_custkey, 1, 'slice', c_mktsegment, c_custkey, c_name FROM customer
  UNION ALL SELECT c_custkey, 2, 'slice', 'nation "' || c_nationkey || '"', c_nationkey + 0.5, c_name FROM customer)""")
def diagram_pies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pie for each customer; a label given twice keeps its first value."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    pie = _text("pie showData title ", F.col("c_name"), '\n"', F.col("c_mktsegment"), '" : ', key, '\n%% c\n"nation \\"', nation, '\\"" : ', nation, '.5\n"', F.col("c_mktsegment"), '" : 7\n')
    whole = _read(spark, sf_dir, "customer").select("c_custkey", G.diagram(pie).alias("d"))
    return whole.select("c_custkey", "d.title", F.inline("d.elements")).select("c_custkey", "place", "kind", "name", "value", "title")


@query("""SELECT s_suppkey, kind, name, text, source, target, style, value::DOUBLE AS value, parent FROM (
  SELECT s_suppkey, 'node' AS kind, 's' || s_suppkey AS name, s_name AS text, NULL AS source, NULL AS target, 'square' AS style, NULL AS value, 'own' AS parent FROM supplier
  UNION ALL SELECT s_suppkey, 'node', 'n' || s_nationkey, 'n' || s_nationkey, NULL, NULL, 'round', NULL, NULL FROM supplier UNION ALL SELECT s_suppkey, 'node', 'end-node', 'x', NULL, NULL, 'hexagon', NULL, NULL FROM supplier
  UNION ALL SELECT s_suppkey, 'group', 'own', 'Of ' || s_suppkey, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT s_suppkey, 'edge', NULL, 'is in', 's' || s_suppkey, 'n' || s_nationkey, 'normal arrow_point', 1, NULL FROM supplier UNION ALL SELECT s_suppkey, 'edge', NULL, 'is in', 's' || s_suppkey, 'end-node', 'normal arrow_point', 1, NULL FROM supplier
  UNION ALL SELECT s_suppkey, 'edge', NULL, '', 'n' || s_nationkey, 'end-node', 'dotted arrow_circle', 2, NULL FROM supplier)""")
def diagram_flowcharts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flowchart for each supplier."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    chart = _text("flowchart LR\ns", key, ' -->|is in| n', nation, " & end-node; n", nation, "-..-oend-node{{x}}\nstyle s fill:red\nsubgraph own [Of ", key, "]\ns", key, '["', F.col("s_name"), '"]\nend\n')
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", chart.alias("chart"))
    return G.diagram_elements(rows, "chart", "s_suppkey").drop("place")


@query("""SELECT conv_id, turn, kind, name, text, source, target, style, value::DOUBLE AS value FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS said, 'r ' || coalesce(role, 'x') AS who FROM conversations) c, LATERAL (
  SELECT 'message' AS kind, NULL AS name, c.said AS text, c.who AS source, 'All' AS target, '->>' AS style, 0 AS value UNION ALL SELECT 'activation', 'All', NULL, NULL, NULL, NULL, 17 UNION ALL SELECT 'message', NULL, c.said, 'All', c.who, '-->>', 1
  UNION ALL SELECT 'deactivation', 'All', NULL, NULL, NULL, NULL, 18 UNION ALL SELECT 'note', NULL, 'turn ' || c.turn, c.who, 'All', 'over', 2) AS x(kind, name, text, source, target, style, value)""".replace("SELECT conv_id, turn, kind, name, text,", "SELECT conv_id, turn, kind, name, x.text AS text,"))
def diagram_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each turn of a conversation: what is said goes out and comes back."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " ")
    who = _text("r ", F.coalesce("role", F.lit("x")))
    sequence = _text("sequenceDiagram\nparticipant ", who, " as Who\n", who, "->>+All: ", said, "\nloop twice\nAll-->>-", who, ": ", said, "\nend\nNote over ", who, ",All: turn ", F.col("turn").cast("string"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", sequence.alias("sequence"))
    kinds = F.col("kind").isin("message", "activation", "deactivation", "note")
    return G.diagram_elements(rows, "sequence", "conv_id", "turn").filter(kinds).drop("place", "parent")


@query("""SELECT o_orderkey, kind, name, text, parent FROM (SELECT o_orderkey, 'section' AS kind, 'Status ' || o_orderstatus AS name, 'Status ' || o_orderstatus AS text, NULL AS parent FROM orders
  UNION ALL SELECT o_orderkey, 'task', '0', 'Order ' || o_orderkey, 'Status ' || o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'event', NULL, o_orderpriority, '0' FROM orders UNION ALL SELECT o_orderkey, 'event', NULL, 'of ' || o_custkey, '0' FROM orders)""")
def diagram_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline for each order."""
    line = _text("timeline\ntitle T\nsection Status ", F.col("o_orderstatus"), "\nOrder ", F.col("o_orderkey").cast("string"), " : ", F.col("o_orderpriority"), "\n  : of ", F.col("o_custkey").cast("string"))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return G.diagram_elements(rows, "line", "o_orderkey").select("o_orderkey", "kind", "name", "text", "parent")


@query("""SELECT page_id, removed_scripts, removed_handlers, kept_link FROM (SELECT page_id, (page_id % 3)::BIGINT AS removed_scripts, 1::BIGINT AS removed_handlers, page_id % 2 = 0 AS kept_link FROM pages)""")
def sanitize_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sanitising takes out of markup with a known number of scripts, one handler and a link that is safe in every other page."""
    link = F.when(F.col("page_id") % 2 == 0, F.lit("/x")).otherwise(F.lit("java\nscript:x"))
    markup = _text(F.repeat(F.lit("<script>x < 1</script>"), (F.col("page_id") % 3).cast("int")), "<b onclick=y>t</b><a href='", link, "'>l</a>")
    clean = _read(spark, sf_dir, "pages").select("page_id", H.sanitized_with_removed(markup).alias("s"))
    count = lambda name, field: F.size(F.filter("s.removed", lambda r: r[field] == name)).cast("long")
    return clean.select("page_id", count("script", "element").alias("removed_scripts"), count("onclick", "attribute").alias("removed_handlers"), F.contains("s.html", F.lit('href="/x"')).alias("kept_link"))
