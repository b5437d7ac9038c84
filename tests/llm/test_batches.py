"""Arrow batches are bounded by bytes, and the session's settings stay."""

from pyspark.sql import functions as F

import pyarrow as pa

from vecskein.llm import common


def test_long_texts_come_in_small_batches(spark):
    df = spark.range(0, 120, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(n) for n in names]
    got = common.materialize(df.mapInArrow(sizes, "n long, size long"), "t").collect()
    assert [spark.conf.get(n) for n in names] == before
    assert sum(r.n for r in got) == 120 and max(r["size"] for r in got) <= common.BATCH_BYTES + (2 << 20)


def test_small_scans_are_dealt_and_large_ones_are_not(spark, tmp_path):
    spark.range(0, 1000, 1, 1).write.parquet(str(tmp_path / "one"))
    spark.range(0, 1000, 1, 8).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    plan = lambda df: common.spread(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(one) and "Repartition" not in plan(many)
    assert common.spread(spark.range(5)).count() == 5
