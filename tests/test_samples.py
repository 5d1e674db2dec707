import os

import pytest

from docloom import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_samples_hold_whole_texts_and_all_orders(spark):
    values = catalogue.samples(spark, SF).cache()
    for table in ("documents", "conversations"):
        texts = spark.read.parquet(f"{SF}/{table}.parquet").filter("text is not null").selectExpr("text as value").distinct()
        assert texts.join(values, "value", "left_anti").count() == 0
    made = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("concat('CSQU', lpad(cast(o_orderkey * 79 as string), 7, '3')) as value")
    assert made.join(values, "value", "left_anti").count() == 0


def test_samples_cut_nothing():
    tables = [x for x in catalogue.SAMPLES.split("UNION ") if "{documents}" in x or "{conversations}" in x or "{orders}" in x]
    assert len(tables) == 14
    assert not [x for x in tables if "WHERE" in x or "LIMIT" in x or "substring" in x]
