"""Range joins by cells and on the grid, for every metric, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein.operators import search


def brute(a, b, radius, metric):
    out = {}
    for i, x in a:
        for j, y in b:
            x_, y_ = np.array(x), np.array(y)
            d = np.sqrt(((x_ - y_) ** 2).sum()) if metric == "l2" else -(x_ @ y_) if metric == "ip" else 1 - x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_)
            if d < radius:
                out[(i, j)] = d
    return out


@pytest.mark.parametrize("metric, radius", [("l2", 0.4), ("l2", 3.0), ("l2", 400.0), ("cosine", 0.02), ("cosine", 0.9), ("ip", -40.0), ("ip", 5.0)])
@pytest.mark.parametrize("spreads", [1.0, 60.0])
def test_range_join(spark, monkeypatch, metric, radius, spreads):
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = lambda n, s: [(f"{s}{k}", (spreads * rng.normal(size=3) + rng.normal(size=3)).tolist()) for k in range(n)]
    a, b = rows(150, "a"), rows(120, "b")
    b += [(f"c{k}", [x + 1e-3 for x in v]) for k, (_, v) in enumerate(a[:30])]
    left = spark.createDataFrame([*a, ("null", None)], "id string, embedding array<double>")
    right = spark.createDataFrame(b, "key string, vec array<double>")
    got = {(r[0], r[1]): r[2] for r in search.range_join(left, right, radius, metric, right_id="key", right_vector="vec").collect()}
    want = brute(a, b, radius, metric)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 * (1 + abs(want[k])) for k in want)


def test_empty_sides_and_bad_dimensions(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    other = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, embedding array<double>")
    for metric in ("l2", "ip", "cosine"):
        assert search.range_join(one.limit(0), one, 1.0, metric).count() == search.range_join(one, one.limit(0), 1.0, metric).count() == 0
        with pytest.raises(Exception, match="unequal"):
            search.range_join(one, other, 1.0, metric).collect()
    assert search.range_join(one, one, 0.0).count() == 0 and search.range_join(one, one, 1.0).first() == (1, 1, 0.0)


def test_large_query_sets_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    e = spark.createDataFrame([(k, v) for k, v in enumerate(rng.normal(size=(300, 5)).tolist())], "id long, embedding array<double>")
    asked = e.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    want = {(r[0], r[1]): r[2] for r in search.knn_join(asked, e, 4).select("query_id", "rank", "id").collect()}
    monkeypatch.setattr(search, "SHIPPED", 0)
    monkeypatch.setattr(search, "BLOCK", 20)
    assert {(r[0], r[1]): r[2] for r in search.knn_join(asked, e, 4).select("query_id", "rank", "id").collect()} == want


def test_grid_does_not_grow_with_shuffle_partitions(spark):
    """Shuffle partitions are set by the input's size; blocks were sent the square root of four times as many times."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        assert search._lines(spark) <= 8  # 90 before
        rows = spark.range(3).select("id", F.array(F.lit(0.5)).cast("array<float>").alias("v"))
        met = search._grid(search._packed(rows.coalesce(1), "a"), search._packed(rows.coalesce(1), "b"))
        assert "sequence(0, 7" in met._jdf.queryExecution().analyzed().toString() and met.agg(F.sum(F.size("a_ids") * F.size("b_ids"))).first()[0] == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_single_precision_is_sent_as_such(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rng.normal(size=(60, 6)).tolist())], "id long, embedding array<float>")
    rows = [(r.id, r.embedding) for r in df.collect()]
    met = search._meeting(df.select("id", F.col("embedding").alias("v")), df.select("id", F.col("embedding").alias("v")), 1.5, "l2")
    assert met.where(F.length("a_data") != 4 * 6 * F.size("a_ids")).count() == 0  # eight bytes a component before
    for metric, radius in (("l2", 1.5), ("cosine", 0.3), ("ip", -2.0)):
        got = {(r[0], r[1]): r[2] for r in search.range_join(df, df, radius, metric).collect()}
        want = brute(rows, rows, radius, metric)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
