"""Several tables that change together: immutable parts, tombstones by key, and a manifest that is written last.

A change writes its parts and tombstones first and then one row set of the manifest under the next version. Readers follow the newest whole manifest, so that a
change is seen in all tables or in none, and one that fails half-way leaves the old state readable. A tombstone hides rows of its key in parts older than
itself; a change may hide a key's rows and bring new ones for it. One writer at a time."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_MANIFEST = "store string, kind string, part string, number long"


class Stores:
    """Tables under path, each with the key column that deletes go by."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str]):
        self.spark, self.path, self.keys = spark, path, keys

    def state(self) -> tuple[int, list]:
        """The newest version and its parts: one row a part or tombstone file, which the driver lists."""
        try:
            every = self.spark.read.schema(_MANIFEST + ", version long").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return 0, []
        newest = every.agg(F.max("version")).first()[0]
        return (0, []) if newest is None else (newest, every.where(F.col("version") == newest).collect())

    def table(self, store: str) -> DataFrame | None:
        """The rows of a table now; None before its first part."""
        return self._rows(store, self.state()[1])

    def _rows(self, store: str, parts: list) -> DataFrame | None:
        own = [p for p in parts if p.store == store]
        live = [self.spark.read.parquet(p.part).withColumn("_n", F.lit(p.number)) for p in own if p.kind == "rows"]
        if not live:
            return None
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), live)
        gone = [self.spark.read.parquet(p.part).withColumn("_g", F.lit(p.number)) for p in own if p.kind == "gone"]
        if gone:
            key = self.keys[store]
            latest = reduce(DataFrame.unionByName, gone).groupBy(F.col("key").alias("_k")).agg(F.max("_g").alias("_g"))
            rows = rows.join(latest, F.col(key) == F.col("_k"), "left").where(F.col("_g").isNull() | (F.col("_g") <= F.col("_n"))).drop("_k", "_g")
        return rows.drop("_n")

    def change(self, rows: dict[str, DataFrame] | None = None, gone: DataFrame | None = None, stores: tuple[str, ...] | None = None) -> int:
        """Hide the keys of gone (its first column) in the named stores, by default in all, and add rows; the new version's number."""
        version, parts = self.state()
        number = version + 1
        new = []
        if gone is not None:
            place = f"{self.path}/parts/{uuid.uuid4().hex}"
            gone.select(F.col(gone.columns[0]).alias("key")).where(F.col("key").isNotNull()).distinct().write.parquet(place)
            new += [(s, "gone", place, number) for s in stores or self.keys]
        for store, df in (rows or {}).items():
            place = f"{self.path}/parts/{uuid.uuid4().hex}"
            df.write.parquet(place)
            new.append((store, "rows", place, number))
        return self._commit([tuple(p[:4]) for p in parts] + new, number)

    def _commit(self, parts: list[tuple], number: int) -> int:
        # one file, which its committer moves into place as a whole
        self.spark.createDataFrame(parts, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/version={number}")
        return number

    def delete(self, keys: DataFrame, reset: dict[str, DataFrame] | None = None) -> bool:
        """Hide the keys (first column) in all tables at once, and add the rows of reset in the same change; whether any table had any of them."""
        parts = self.state()[1]
        wanted = keys.select(F.col(keys.columns[0]).alias("_k")).distinct()
        had = [t.join(wanted, F.col(self.keys[s]) == F.col("_k"), "left_semi").limit(1).count() for s in self.keys if (t := self._rows(s, parts)) is not None]
        if not any(had):
            return False
        self.change(reset, keys)
        return True

    def compact(self, store: str) -> int:
        """Write what a table holds now as one part without tombstones; its rows stay the same."""
        version, parts = self.state()
        rows = self._rows(store, parts)
        kept = [tuple(p[:4]) for p in parts if p.store != store]
        if rows is not None:
            place = f"{self.path}/parts/{uuid.uuid4().hex}"
            rows.write.parquet(place)
            kept.append((store, "rows", place, version + 1))
        return self._commit(kept, version + 1)
