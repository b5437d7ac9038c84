"""Range joins dealt by several pivots: fewer pairs of blocks meet, and none that holds a pair is passed over."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein.operators import search

from .test_joins_in_blocks import brute


@pytest.fixture(scope="module")
def clusters(spark):
    """Twelve tight clusters in 24 dimensions, all as far from the origin as from each other."""
    rng = np.random.default_rng(3)
    centres = 10 * np.linalg.qr(rng.normal(size=(24, 24)))[0][:12]
    rows = [(k, (centres[k % 12] + 0.1 * rng.normal(size=24)).tolist()) for k in range(720)]
    return spark.createDataFrame(rows, "id long, v array<double>"), rows


@pytest.mark.parametrize("metric, radius", [("l2", 0.6), ("l2", 14.0), ("cosine", 0.001)])
def test_pairs_of_clusters(clusters, monkeypatch, metric, radius):
    monkeypatch.setattr(search, "BLOCK", 32)
    df, rows = clusters
    got = {(r[0], r[1]): r[2] for r in search.range_join(df, df, radius, metric, left_vector="v", right_vector="v").collect()}
    want = brute(rows, rows, radius, metric)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def compared(met):
    return met.agg(F.sum(F.size("a_ids").cast("long") * F.size("b_ids"))).first()[0] or 0


def test_blocks_apart_do_not_meet(clusters, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 32)
    df, rows = clusters
    many = compared(search._meeting(df, df, 0.6, "l2"))
    one = compared(search._meeting(df, df, 0.6, "l2", rows[0][1]))
    # a single pivot tells its own cluster from the others alone; twelve tell each from each
    assert many <= len(rows) ** 2 / 12 * 1.05 < one / 5
    assert compared(search._meeting(df, df, 100.0, "l2")) == compared(search._meeting(df, df, 1.0, "ip")) == len(rows) ** 2


@pytest.mark.parametrize("metric, radius", [("l2", 1.5), ("l2", 1e-3), ("cosine", 0.3)])
def test_rows_beside_bad_components(spark, metric, radius):
    """Components that aren't finite match nothing and hide no row dealt with them."""
    rng = np.random.default_rng(4)
    good = [(k, v) for k, v in enumerate(rng.normal(size=(40, 3)).tolist())]
    bad = [(100, [float("nan"), 1.0, 1.0]), (101, [float("inf"), 1.0, 1.0]), (102, [1.0, None, 1.0]), (103, [float("-inf")] * 3)]
    zero = [(200, [0.0, 0.0, 0.0])] if metric == "l2" else []
    df = spark.createDataFrame([*bad, *good, *zero, (300, None)], "id long, v array<double>")
    got = {(r[0], r[1]) for r in search.range_join(df, df, radius, metric, left_vector="v", right_vector="v").collect()}
    assert got == set(brute([*good, *zero], [*good, *zero], radius, metric))
    none = df.where("id BETWEEN 100 AND 199")
    assert search.range_join(none, df, radius, metric, left_vector="v", right_vector="v").count() == search.range_join(df, none, radius, metric, left_vector="v", right_vector="v").count() == 0
