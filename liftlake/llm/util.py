"""Small steps shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.session import shared_dir


def fold(column, modulus: int) -> Column:
    """crc32 of an id's text, modulo a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def saved(df: DataFrame, purpose: str, parts: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there.

    ``parts`` bounds the number of files, for tables whose rows were counted.
    """
    path = shared_dir(df.sparkSession, purpose)
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function out of one for a single batch; empty batches pass it by."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run
