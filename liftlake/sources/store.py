"""A stored table that takes batches: small new folders, merged as they add up.

Each batch is one folder. As soon as a level holds ``fan`` folders they are merged
into one of the next level, so ``n`` batches leave at most ``fan - 1`` folders on
each of about ``log(n) / log(fan)`` levels, and a row is rewritten once a level. A
manifest names the current folders. A batch counts from the moment its manifest is
published; repeating a counted one changes nothing, and what a failed one left is
never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from liftlake.sources.manifest import Manifest

FAN = 8
BATCH = "written_in"


class BatchStore:
    """Rows by key: those that the newest batch holding the key gave.

    ``unique``: a batch holds a key once; the newest row is then found by an
    aggregation with map-side combine. Otherwise a batch replaces all rows of its
    keys. ``partition_by``: columns that name folders, for reads that ask for some.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], unique: bool = False, partition_by=(), fan: int = FAN):
        self.spark, self.path, self.keys, self.unique = spark, path.rstrip("/"), list(keys), unique
        self.partition_by, self.fan = list(partition_by), fan
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = StructType([*self.schema.fields, StructField(BATCH, LongType())])
        self.manifest = Manifest(spark, self.path)

    def entries(self) -> list[dict]:
        """Current folders, oldest first: name, level, number of batches."""
        return self.manifest.load().get("entries", [])

    def last_batch(self) -> int | None:
        return self.manifest.load().get("last_batch")

    def commit(self, batch_id: int, rows: DataFrame) -> bool:
        """Store a batch; False if it, or a later one, is stored already."""
        state = self.manifest.load()
        if batch_id <= state.get("last_batch", batch_id - 1):
            return False
        batch = rows.select(*self.schema.names).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        entries = [*state.get("entries", []), self._write(batch, 0, 1)]
        while crowded := self._crowded(entries):
            merged = self._write(self._newest(self._union(crowded)), crowded[0]["level"] + 1, sum(e["batches"] for e in crowded))
            at = entries.index(crowded[0])
            entries = [*entries[:at], merged, *entries[at + len(crowded):]]
        self.manifest.publish({"last_batch": batch_id, "entries": entries})
        self._vacuum()
        return True

    def _crowded(self, entries: list[dict]) -> list[dict]:
        for level in sorted({e["level"] for e in entries}):
            same = [e for e in entries if e["level"] == level]
            if len(same) >= self.fan:
                return same
        return []

    def _write(self, rows: DataFrame, level: int, batches: int) -> dict:
        name = f"level{level}-{uuid.uuid4().hex}"
        # Rows of one partition go to one task, or to several where it is large.
        out = rows.hint("rebalance", *self.partition_by) if self.partition_by else rows
        out.write.partitionBy(*self.partition_by).parquet(f"{self.path}/data/{name}")
        return {"name": name, "level": level, "batches": batches}

    def _union(self, entries: list[dict], where: Column | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], self.stored)
        # Folders without partitions are one read; partitioned ones have a root each.
        paths = [f"{self.path}/data/{e['name']}" for e in entries]
        for group in ([[p] for p in paths] if self.partition_by else [paths] * bool(paths)):
            out = out.unionByName(self.spark.read.schema(self.stored).parquet(*group).select(*self.stored.names))
        return out if where is None else out.where(where)

    def _newest(self, rows: DataFrame) -> DataFrame:
        if self.unique:
            values = [c for c in rows.columns if c not in self.keys]
            return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), BATCH).alias("v")).select(*self.keys, "v.*").select(*rows.columns)
        newest = F.max(BATCH).over(Window.partitionBy(*self.keys))
        return rows.withColumn("newest", newest).where(F.col(BATCH) == F.col("newest")).drop("newest")

    def read(self, where: Column | None = None) -> DataFrame:
        """Current rows; ``where`` may name keys and partition columns and is applied in the scans."""
        return self._newest(self._union(self.entries(), where)).drop(BATCH)

    def _vacuum(self) -> None:
        """Delete folders that no kept version names."""
        named = {e["name"] for v in self.manifest.versions() for e in self.manifest.load(v).get("entries", [])}
        for name in self.manifest.children(f"{self.path}/data"):
            if name not in named:
                self.manifest.remove(f"{self.path}/data/{name}")
