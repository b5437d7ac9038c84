"""A log of sampled query vectors per index: bounded, newest kept, readable as a table.

A record is one small JSON file in the folder of its index, written and trimmed by the driver: a search that is sampled runs no
Spark job for it.
"""

from __future__ import annotations

import random
import time
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecskein.plans.options import scan_options
from vecskein.sources import store

SCHEMA = "index_name string, table_name string, column_name string, operator string, value string, created_at double"
OPERATORS = {"l2": "<->", "ip": "<#>", "cosine": "<=>", "maxsim": "@#"}


def text_of(vector) -> str:
    """[0.5,0.25,1]."""
    return "[" + ",".join(str(int(v)) if float(v).is_integer() else repr(float(v)) for v in vector) + "]"


class QueryLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, index_name: str, table_name: str, column_name: str, metric: str, vector, rng=random, **given) -> bool:
        """Log a query with the set probability; afterwards exactly the newest max_records stay."""
        opts = scan_options(self.spark, "log", given)
        if vector is None or not opts["enable"] or not opts["max_records"] or rng.random() >= opts["rate"]:
            return False
        folder, now = self._folder(index_name), time.time()
        row = {"index_name": index_name, "table_name": table_name, "column_name": column_name, "operator": OPERATORS[metric], "value": text_of(vector), "created_at": now}
        store.write_json(self.spark, f"{folder}/{int(now * 1e6):020d}-{uuid.uuid4().hex}.json", row)
        for old in store.children(self.spark, folder)[: -opts["max_records"]]:
            store.remove(self.spark, f"{folder}/{old}")
        return True

    def _folder(self, index_name: str) -> str:
        return f"{self.path}/{quote(index_name, safe='')}"

    def _all(self) -> DataFrame:
        if not store.children(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(self.path)

    def sampled_values(self, index_name: str) -> DataFrame:
        return self._all().where(F.col("index_name") == index_name).select("value")

    def sampled_queries(self, index_name: str | None = None) -> DataFrame:
        rows = self._all() if index_name is None else self._all().where(F.col("index_name") == index_name)
        return rows.select("index_name", "table_name", "column_name", "operator", "value")

    def create_view(self, name: str = "sampled_queries") -> None:
        self.sampled_queries().createOrReplaceTempView(name)

    def drop(self, index_name: str | None = None) -> None:
        """Forget one index, or everything."""
        store.remove(self.spark, self.path if index_name is None else self._folder(index_name))
