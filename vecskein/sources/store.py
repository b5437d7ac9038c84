"""Index directories: small JSON documents and Parquet parts under versioned folders, by Spark's file systems."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(p) else []


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Whole or not at all: written aside, then renamed over the old one in one step.

    Where a store has no such rename (object stores), the object is put in place of the old one, which is one step there.
    """
    fs, p = _fs(spark, path)
    raw = bytearray(json.dumps(value).encode())
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = p.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf)
    except Py4JJavaError:
        context = None
    q = p if context is None else jvm.org.apache.hadoop.fs.Path(f"{p.toString()}.{uuid.uuid4().hex}")
    out = fs.create(q, True)
    out.write(raw)
    out.close()
    if context is not None:
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(q, p, how)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def read_parts(spark: SparkSession, path: str, schema) -> DataFrame:
    """All Parquet parts below ``path``; none is an empty table."""
    names = children(spark, path)
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def next_seq(spark: SparkSession, root: str, kinds: tuple[str, ...]) -> int:
    """A number above those of all parts ``seq=N`` below ``root``/kind."""
    return 1 + max((int(n.removeprefix("seq=")) for k in kinds for n in children(spark, f"{root}/{k}") if n.startswith("seq=")), default=0)


def read_seqs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All parts ``seq=N`` below ``path``, their number in column seq; none is an empty table. ``schema`` names seq."""
    return spark.read.schema(schema).parquet(path) if children(spark, path) else spark.createDataFrame([], schema)


def live(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``rows`` (row_id, seq, ...) that no later tombstone hides: one hides the parts before it, not those after."""
    if not children(spark, path):
        return rows
    gone = read_seqs(spark, path, "row_id long, seq int").groupBy("row_id").agg(F.max("seq").alias("_gone"))
    return rows.join(gone, "row_id", "left").where("_gone IS NULL OR seq > _gone").drop("_gone")


@contextmanager
def phases(spark: SparkSession, told: Callable[[str], None] | None = None) -> Iterator[Callable[[str], None]]:
    """A function that announces the phases of a build: to the log, to ``told``, and as description of Spark's jobs."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.job.description")

    def phase(name: str) -> None:
        sc.setLocalProperty("spark.job.description", f"vecskein: {name}")
        logging.getLogger("vecskein").info("build: %s", name)
        if told is not None:
            told(name)

    try:
        yield phase
    finally:
        sc.setLocalProperty("spark.job.description", before)
