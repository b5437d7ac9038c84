"""Shared helpers: scratch tables in the cluster's shared folder, Arrow batches, ids."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecskein.session import held, spread

__all__ = ["LAST_ID", "id_or_last", "join_unique", "materialize", "release", "remove", "scratch_path", "shared_dir", "spread", "text_bytes"]

#: Sorts after every real id: rows without an id never count as the earlier copy. A real id of this value is taken for none.
LAST_ID = 2**63 - 1
#: One Arrow batch of whole texts: rows, and bytes (one longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a local temporary folder is made.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = sc.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="vecskein-")
            atexit.register(_remove_local, _own[app])
        found = _own[app]
    return found.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/vecskein-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str = "zstd", rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` to a scratch table in the shared folder and read it back; a scratch table is given back as it is.

    Lineage ends there, so a lost executor costs a re-read instead of a recomputation. While it is written, Arrow batches
    are bounded by rows and bytes, and its shuffle files go with the end of the write; the session's settings stay.
    """
    if getattr(df, "_vecskein_path", None):
        return df
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with held(spark, {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecskein_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a scratch table that no later read needs."""
    path = getattr(df, "_vecskein_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def id_or_last(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


#: A key is hot with more than this part of all rows, so that there are fewer hot keys than this says.
HOT_KEYS = 1000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined by ``keys`` with ``right``, which has every key once; ``counts`` (keys, n) are the rows of left by key.

    Hot keys, fewer than ``HOT_KEYS`` whatever the rows, go out with their rows of right to where left lies, which is not moved for
    them; the others are dealt by key. Keys are not null. ``how`` is inner or left.
    """
    total = counts.agg(F.sum("n")).first()[0]
    hot = counts.where(F.col("n") > F.lit((total or 0) // HOT_KEYS)).select(*keys)
    if hot.isEmpty():
        return left.join(right, keys, how)
    near = left.join(F.broadcast(hot.join(right, keys, how)), keys)
    far = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    return near.unionByName(far)
