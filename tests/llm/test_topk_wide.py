"""Scores near and beyond a long, cutoffs from part of the blocks, and what the search leaves of the session."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vecskein.llm import topk

from .test_files import brute_topk

KIND = "vec_id long, embedding array<double>"


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(k, [float(2**22 + k), 3.0 * k, -(2.0**21), 1.0]) for k in range(60)]
    got = topk.search(spark.createDataFrame(rows, KIND), F.expr("vec_id % 50 = 0"))
    assert Counter(map(tuple, got.collect())) == brute_topk(rows)


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_a_score_beyond_a_long_is_an_error(spark, sign):
    rows = [(0, [8e9] * 4), (1, [sign * 8e9] * 4), (2, [1.0] * 4)]
    with pytest.raises(Exception, match="beyond a long"):
        topk.search(spark.createDataFrame(rows, KIND), F.expr("vec_id % 50 = 0")).collect()


def test_beyond_a_long_but_not_among_the_best(spark):
    rows = [(0, [8e9] * 4), (1, [-8e9] * 4), *((k, [float(k), 0.0, 0.0, 0.0]) for k in range(2, 9))]
    got = topk.search(spark.createDataFrame(rows, KIND), F.expr("vec_id % 50 = 0"), k=3)
    assert Counter(map(tuple, got.collect())) == brute_topk(rows, 3)


@pytest.mark.parametrize("pilot", [1, 3, 1000])
def test_cutoffs_from_part_of_the_blocks(spark, pilot):
    rnd = random.Random(pilot)
    vec = lambda s: [s * rnd.gauss(0, 1) for _ in range(9)]
    rows = [(k, vec(rnd.choice([0.01, 1.0, 30.0]))) for k in range(700)] + [(700 + k, [1.0] * 9) for k in range(40)]
    df = spark.createDataFrame(rows, KIND)
    assert Counter(map(tuple, topk.search(df, F.expr("vec_id % 50 = 0"), rows=32, queries=5, pilot=pilot).collect())) == brute_topk(rows)


def test_session_stays_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    topk.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], KIND), F.expr("vec_id % 50 = 0")).collect()
    assert spark.conf.get(name) == before
