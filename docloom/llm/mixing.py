"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, dropped, shuffle_partitions, written

#: Rows of one range partition of the queue, about.
RANGE_ROWS = 2_000_000
#: Documents of one source are summed up in parts of about this many.
PART_ROWS = 50_000


def shared_out(sums: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """Targets in proportion to weights that add up to the budget, none above `most` times its source's size: (source, size) to source, source_rank, source_size, target.

    What a source can't take is shared among the others by weight, until none is above. In order of cap / weight,
    every source from the first on whose cap is above it gets level * weight, where level = (budget - the caps before) /
    (the other sources' weights). One row per source, and nothing else, goes through one task's sort.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.select("source", F.col("size").alias("source_size"), (F.row_number().over(order) - 1).alias("source_rank"))
    ranked = ranked.withColumn("weight", F.element_at(given, (F.col("source_rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shares = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level of the first source whose cap is above it holds for all after it
    levels = ranked.withColumn("level", F.when(F.col("cap") / F.col("weight") > left / shares, left / shares))
    level = F.first("level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return levels.select("source", "source_rank", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def mix(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_cols: tuple[str, ...] = ()) -> DataFrame:
    """How much of each document the mix takes: doc_id, source, size, source_size, target, taken.

    Size is the number of words (null text: 0). Sources in order of their code points, null last, get the
    weights in turn. A source's documents queue in the order of a hash of their id and size, once or, if its
    target exceeds its size, again from the start. A queued copy's virtual finish time is its source's words up to and
    including it, divided by the source's target; all copies are range-sorted by it and taken while the words
    taken stay within the budget. Documents are taken whole, so a source ends within one document of its
    target. Documents of size 0 aren't queued (taken 0). Ties in time go by source, hash and id; repeated rows
    are documents of their own; null ids queue like others; an empty table gives an empty result. Nothing but
    two totals and one row per sort partition reaches the driver. Other columns aren't read, but for row_cols:
    these order equal rows and stand in the result.
    """
    spark = documents.sparkSession
    base = documents.select(
        *row_cols,
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    base = written(base.withColumn("turn", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")).cast("binary"))), "mix-sizes")
    by_source = written(base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    total, rows = by_source.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    budget = share * total
    # broadcast only if it is small, as the size of its files tells
    table = written(shared_out(by_source, weights, budget, most), "mix-targets")
    docs = base.join(table, base["source"].eqNullSafe(table["source"])).drop(table["source"])
    digits = 1
    while rows / 16**digits > PART_ROWS:
        digits += 1
    queued = docs.filter("size > 0").withColumn("part", F.substring("turn", 1, digits))
    cells = queued.groupBy("source_rank", "part").agg(F.sum("size").alias("n"))
    ahead = cells.select("source_rank", "part", F.coalesce(F.sum("n").over(Window.partitionBy("source_rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    so_far = F.sum("size").over(Window.partitionBy("source_rank", "part").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queue = queued.withColumn("upto", so_far).join(ahead, ["source_rank", "part"]).withColumn("upto", F.col("upto") + F.col("ahead"))
    rounds = int(most) + (most > int(most))
    copies = queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("upto", F.col("upto") + F.col("copy") * F.col("source_size"))
    # a copy whose service starts after time 1 can't be reached: by then the sources have filled the budget
    copies = copies.withColumn("finish", F.col("upto").cast("double") / F.col("target")).filter((F.col("upto") - F.col("size")).cast("double") < F.col("target"))
    keys = ["finish", "source_rank", "turn", "doc_id", "copy"]
    columns = ["doc_id", "source_rank", "size", "turn", "copy", "finish"]
    ordered = copies.select(*columns).repartitionByRange(max(shuffle_partitions(spark), -(-rounds * rows // RANGE_ROWS)), *keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())
    ordered = written(ordered, "mix-order")
    loads = ordered.groupBy("pid").agg(F.sum("size")).collect()  # one row per partition of the sort
    taken, cut = 0, None
    for pid, n in sorted((r[0], r[1]) for r in loads):
        if taken + n > budget:
            cut = pid
            break
        taken += n
    whole = ordered.filter(F.col("pid") < cut) if cut is not None else ordered
    if cut is not None:
        upto = F.sum("size").over(Window.partitionBy("pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        part = ordered.filter(F.col("pid") == cut).withColumn("upto", upto).filter(F.col("upto") + F.lit(taken) <= F.lit(budget)).drop("upto")
        whole = whole.unionByName(part)
    # equal rows share what their group takes: equal parts, and one copy more for the first of them
    per_copy = written(whole.groupBy("doc_id", "turn", "size", "source_rank").agg(F.sum("size").alias("sum_taken")), "mix-taken")
    dropped(ordered, by_source)
    same = Window.partitionBy("turn", "doc_id", "size", "source_rank")
    numbered = docs.withColumn("_k", F.row_number().over(same.orderBy("turn", *row_cols))).withColumn("_n", F.count(F.lit(1)).over(same))
    out = numbered.alias("d").join(
        per_copy.alias("t"),
        F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.turn") == F.col("t.turn")) & (F.col("d.size") == F.col("t.size")) & (F.col("d.source_rank") == F.col("t.source_rank")),
        "left",
    )
    units = F.coalesce(F.col("t.sum_taken"), F.lit(0)) / F.greatest(F.col("d.size"), F.lit(1))
    share_of = F.floor(units / F.col("d._n")) + (F.col("d._k") <= F.pmod(units, F.col("d._n"))).cast("int")
    return out.select(*[f"d.{c}" for c in row_cols], "d.doc_id", "d.source", "d.size", "d.source_size", "d.target", (share_of * F.col("d.size")).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as mix() takes it, columns as they are, whatever their names.

    Documents without words, and null texts, aren't in it. Of rows that share an id, or are equal, each comes as
    often as the mix takes it; ties are broken as in mix(). An empty table gives an empty one.
    """
    columns = [f"`{c}`" for c in documents.columns]
    own = {"id": id_col, "text": text_col, "source": source_col}
    rows = documents.select(F.struct(*columns).alias("row"), *[F.col(f"`{c}`").alias(k) for k, c in own.items()], F.xxhash64(*columns).alias("tie"), F.monotonically_increasing_id().alias("number"))
    rows = written(rows, "mix-rows")
    taken = mix(rows, id_col="id", row_cols=("tie", "number"), **options).filter("taken > 0")
    joined = rows.select("row", "number").join(taken.select("number", F.expr("int(taken div size)").alias("times")), "number")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(f"row.{c}") for c in columns])
