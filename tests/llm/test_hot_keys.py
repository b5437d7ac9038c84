"""Joins that broadcast hot keys: the rows of a plain join, and hot rows not moved."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from vecskein.llm import common, simhash, substrings

from .test_files import brute_dedup
from .test_texts import classes


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [1000, 3, 1])
def test_join_unique_is_the_plain_join(spark, monkeypatch, how, share):
    monkeypatch.setattr(common, "HOT_KEYS", share)
    left = spark.range(600).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"), F.lit("x").alias("w"))
    right = spark.createDataFrame([(k, str(k)) for k in range(0, 40, 2)] + [(7, "hot")], "k long, name string")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for l_, r_ in ((left, right), (left.limit(0), right), (left, right.limit(0))):
        own = counts if l_ is left else counts.limit(0)
        got = common.join_unique(l_, r_, ["k"], own, how)
        want = l_.join(r_, "k", how)
        assert set(got.columns) == set(want.columns)
        assert Counter(map(tuple, got.select("k", "v", "w", "name").collect())) == Counter(map(tuple, want.select("k", "v", "w", "name").collect()))


def test_hot_rows_are_not_shuffled(spark, tmp_path):
    """Of two hot thirds only the broadcast moves: the shuffle side of the plan filters them out first."""
    keys = F.when(F.col("id") % 3 < 2, F.col("id") % 3).otherwise(F.col("id"))
    spark.range(30_000).select(keys.alias("k"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/left")
    left = spark.read.parquet(f"{tmp_path}/left")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    right = counts.select("k", (F.col("k") + 1).alias("r"))
    hot = counts.where(F.col("n") > 30_000 // common.HOT_KEYS)
    assert sorted(r.k for r in hot.collect()) == [0, 1]
    out = common.join_unique(left, right, ["k"], counts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 30_000 and "LeftAnti" in plan and plan.count("strategy=broadcast") >= 2


def test_operators_with_hot_keys(spark, monkeypatch):
    """A third of all rows are one text, a sixth have no word; hot keys are those over a third, then over a thousandth."""
    same = "one passage that a third of all the rows of this table hold word for word, long enough to be found twice " * 2
    rows = [(k, same) for k in range(40)] + [(100 + k, " " * (k % 3)) for k in range(20)] + [(200 + k, f"{same[: 120 + k]} and its own end {k * k} " * (1 + k % 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (4, 1000):
        monkeypatch.setattr(common, "HOT_KEYS", share)
        assert Counter(map(tuple, substrings.dedup(df).collect())) == brute_dedup(rows)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
        want = {i: c for i, _, c in classes(rows)}
        assert got == want
        assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(i for i, c in want.items() if i == c)
