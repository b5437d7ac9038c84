"""One inverted-list index per partition of a table, searched as one.

A partition is a named condition over the table, as a list of its values would give it; every partition has an index of its
own, with options of its own if need be. A search unions the scans of the partitions it names (all, unless told
otherwise) and ranks what each lets go, so at most k rows of a partition meet.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

from vecskein.plans.ivf import IvfIndex
from vecskein.sources import store


class PartitionedIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self.conditions: dict[str, str] = store.read_json(spark, f"{self.path}/partitions.json")
        self.parts = {name: IvfIndex(spark, f"{self.path}/{name}") for name in self.conditions}

    @classmethod
    def build(cls, df: DataFrame, path: str, partitions: dict[str, str], metric: str = "l2", options: str | dict | None = None, own_options: dict[str, str | dict] | None = None, **kw) -> PartitionedIndex:
        """``partitions``: SQL conditions by name, which must not overlap; ``own_options`` take the place of ``options``."""
        for name, condition in partitions.items():
            if not name.isidentifier():
                raise ValueError(f"a partition is named by an identifier, not {name!r}")
            IvfIndex.build(df, f"{path.rstrip('/')}/{name}", metric, (own_options or {}).get(name, options), where=condition, **kw)
        store.write_json(df.sparkSession, f"{path.rstrip('/')}/partitions.json", partitions)
        return cls(df.sparkSession, path)

    def search(self, query, k: int | None = 10, table: DataFrame | None = None, where: Column | str | None = None, partitions: Iterable[str] | None = None, **scan) -> DataFrame:
        """(row_id, distance, emitted), as one index would give them; ``partitions`` prunes."""
        names = list(self.parts if partitions is None else partitions)
        if not names:
            raise ValueError("a search needs a partition")
        found = reduce(DataFrame.unionByName, (self.parts[n].search(query, k, table, where, **scan) for n in names)).orderBy("emitted", "row_id")
        return found if k is None else found.limit(k)

    def insert(self, df: DataFrame) -> None:
        """Every partition takes its own rows."""
        for part in self.parts.values():
            part.insert(df)

    def delete(self, ids: DataFrame, id_col: str = "row_id") -> None:
        for part in self.parts.values():
            part.delete(ids, id_col)

    def vacuum(self) -> None:
        for part in self.parts.values():
            part.vacuum()

    def drop(self) -> None:
        for part in self.parts.values():
            part.drop()
        store.remove(next(iter(self.parts.values())).spark, self.path)
