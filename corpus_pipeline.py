"""A corpus pipeline of five stages over `documents`: quality rules, near-duplicates, repeated passages, mixing, encoding."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import minhash, mixing, pieces, quality, suffixes
from docloom.llm.common import deleted, folders, recorded, rests_on_files, written

_LEFT: list[str] = []  # scratch tables of stages that have run


def _stage(f):
    """f, which first deletes the scratch tables of stages before it, once nothing reads them any more.

    That is when docs rests on files alone, as when the stage before was written and read again; the files it reads stay.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if rests_on_files(docs):
            own = folders(docs)
            for path in [x for x in _LEFT if not any(o.endswith(x.split("/docloom/")[-1]) for o in own)]:
                deleted(spark, path)
                _LEFT.remove(path)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the line field accept.

    Null and empty texts have too few words and go. Null ids and repeated rows are judged like others. Columns of any
    names stay as they are. An empty table, or one without labels, gives what the base rules keep.
    """
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, field)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, null ids last; rows that share an id are documents of their own.

    Of rows with one id the first by a hash of all columns stays, of equal rows any one. Null and empty texts are linked
    with nothing and stay. Columns of any names stay as they are. An empty table gives an empty one.
    """
    columns = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), "doc_id", "text", F.xxhash64(*columns).alias("tie"), F.monotonically_increasing_id().alias("number"))
    rows = written(rows, "near-rows")
    groups = minhash.near_duplicates(rows, width=5, similarity=0.8, id_col="number")
    own = rows.select("number", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "tie", "number").alias("at"))
    members = written(groups.select(F.col("doc_id").alias("number"), "component_id").join(own, "number"), "near-groups")
    first = members.groupBy("component_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = members.join(first, "component_id").filter(F.col("at.number") != F.col("first.number")).select("number")
    return rows.join(gone, "number", "left_anti").select(*[F.col(f"row.{c}") for c in columns])


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 or more that occur twice; documents of which nothing is left go.

    Null and empty texts stay. Of rows with equal long texts all lose them (the stage before leaves one of them). n_chars
    follows the text; other columns of any names stay as they are. An empty table gives an empty one.
    """
    out = suffixes.without_repeats(docs, length=200)
    return out.withColumn("n_chars", F.length("text").cast("long"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null, empty and wordless texts have size 0 and aren't in the mix. Null ids and repeated rows queue like others.
    Columns of any names stay as they are. An empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document of the mix.

    Null and empty texts have no ids. Null ids and repeated rows are encoded like others. Other columns aren't read. An
    empty table gives an empty one.
    """
    return pieces.encode(docs, pieces.default_model())


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", near_duplicates), ("suffix_dedup", repeated_passages), ("mixing", mixture), ("sentencepiece", encoding)]

#: The field's fit, bit signatures and the search over pieces aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        _LEFT.append(made[-1])
    return STAGES[-1][1](spark, docs, sf_dir)
