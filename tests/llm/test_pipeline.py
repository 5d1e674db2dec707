import os

import pytest

import corpus_pipeline
from docloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_dedup", "mixing", "sentencepiece"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_each_stage_works_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        assert 0 < docs.count() <= before, name
        before = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.select("doc_id").collect()} <= ids
    out = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert out.count() == mixed.count() and out.filter("not round_trip").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_held_out_labels(spark):
    """Fitted on one half of the labelled documents, the field judges the other half."""
    from docloom.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.rate(docs, field).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, copies without an id and a unique text under a copy's id, through stages 2 and 3."""
    text = lambda k: " ".join(f"w{k}x{i * i % 997}" for i in range(80))
    rows = [(7, text(1), "a"), (7, text(1), "a"), (None, text(2), "a"), (None, text(2), "b"), (None, text(2), "b"), (3, text(3), "a"), (9, text(3), "a"), (9, text(4), "a"), (5, "", "a"), (5, "", "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    near = corpus_pipeline.near_duplicates(spark, docs, SF).cache()
    assert near.columns == docs.columns
    left = sorted(((r.doc_id or 0, r.text or "") for r in near.collect()))
    assert left == sorted([(7, text(1)), (0, text(2)), (3, text(3)), (9, text(4)), (5, ""), (5, ""), (0, "")])
    out = corpus_pipeline.repeated_passages(spark, near, SF).collect()
    assert sorted(r.text for r in out if r.text) == sorted(text(k) for k in (1, 2, 3, 4))


CLASHING = "gone_id long, _times long, _copy int, _row long, number long, row string, tie long, id long, times int, copy int, size long, `a.b` string"


def test_stages_with_odd_rows_and_columns(spark, tmp_path):
    """Nulls, repeated rows, columns with clashing names: every stage gives whole rows, columns as they were."""
    text = lambda k: " ".join(f"word{k}x{i * i % 97}" for i in range(60)) + "."
    rows = [(i, text(i), f"s{i % 3}", "en", 9) for i in range(12)] + [(3, text(3), "s0", "en", 9)] * 2 + [(None, text(50), None, None, None), (None, None, None, None, None), (13, "", "s1", "en", 0), (14, None, "s1", "en", 0)]
    extra = (1, 2, 3, 4, 5, "r", 6, 7, 8, 9, 10, "z")
    docs = spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, source string, lang string, n_chars long, {CLASHING}").repartition(3)
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path)).cache()
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        if k < 4:
            assert out.columns == docs.columns == none.columns, name
            assert all(tuple(r)[5:] == extra for r in out.collect()), name
        if k == 0:
            assert out.count() == 15  # null and empty texts go
        elif k == 1:
            assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([*[(i, text(i)) for i in range(12)], (0, text(50)), (0, ""), (13, ""), (14, "")])
        elif k == 2:
            assert out.filter("doc_id = 3").count() == 0 and out.count() == 15  # the repeated row's text is long enough to go
        elif k == 4:
            assert out.count() == docs.count() and out.filter("not round_trip").count() == 0
