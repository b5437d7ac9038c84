"""Streams of rows into an index, and searches over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecskein.functions import vectors as V


def ingest(stream: DataFrame, index, checkpoint: str, op_col: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append every micro-batch to ``index`` (of either kind); with ``op_col``, rows marked "delete" become tombstones.

    Deletes of a batch come before its inserts: an id with both is updated, one deleted alone goes. Ids that the index
    holds, and the batch doesn't delete, are left out of its inserts, so that a batch replayed after a failure stores nothing twice.
    """
    id_col = index.meta["id_col"]

    def apply(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        key = F.col(id_col).cast("long").alias("row_id")
        if op_col:
            gone = batch.where(F.col(op_col) == "delete").select(key)
            if not gone.isEmpty():
                index.delete(gone)
            batch_rows = batch.where(F.col(op_col).isNull() | (F.col(op_col) != "delete")).drop(op_col)
        else:
            batch_rows = batch
        known = index.known_ids().select(F.col("row_id").alias("_known"))
        batch_rows = batch_rows.join(known, F.col(id_col).cast("long") == F.col("_known"), "left_anti")
        if not batch_rows.isEmpty():
            index.insert(batch_rows)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def matches(stream: DataFrame, center, radius: float, metric: str = "l2", vector_col: str = "embedding") -> DataFrame:
    """The rows of a stream strictly inside a sphere, as they come."""
    return stream.withColumn("distance", V.distance(metric, F.col(vector_col), V.vector(center))).where(F.col("distance") < float(radius))
