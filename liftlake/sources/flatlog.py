"""The stored flat log: one row per set with its workout's user and date, so that reading it needs no join.

Files lie in a folder per month and version, sorted by user and date. A manifest
names the version of each month. New months are written beside the old ones and
count from the moment the manifest is published: a replacement happens as a whole
or not at all, and a reader never sees half of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.operators.common import for_users
from liftlake.sources.manifest import Manifest

COLUMNS = ("user_id bigint, workout_id bigint, workout_date date, split_focus string, created_at timestamp_ntz, exercise_id bigint, "
           "slug string, set_number int, weight_kg decimal(6,2), reps int, rpe int")
# Rows of a file, about 100 MB.
MAX_RECORDS_PER_FILE = 10_000_000


def flat_rows(t, users=None) -> DataFrame:
    """Sets with their workout's columns and their exercise's slug."""
    w = for_users(t["workouts"], users).select("workout_id", "user_id", "workout_date", "split_focus", "created_at")
    sets = t["workout_sets"]
    rpe = F.col("rpe") if "rpe" in sets.columns else F.lit(None).cast("int")
    e = t["exercises"].select("exercise_id", "slug")
    return sets.select("workout_id", "exercise_id", "set_number", "weight_kg", "reps", rpe.alias("rpe")) \
        .join(w, "workout_id").join(e, "exercise_id", "left").to(_schema(sets.sparkSession))


def _schema(spark: SparkSession):
    return spark.createDataFrame([], COLUMNS).schema


class FlatLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, self.path)

    def months(self) -> dict[str, str]:
        """Version of each stored month."""
        return self.manifest.load().get("months", {})

    def _put(self, rows: DataFrame, kept: dict[str, str]) -> None:
        """Write rows as a new version and publish it beside the months that are kept."""
        version = uuid.uuid4().hex
        # Ranges follow the data: a large month is cut by user and date into as many tasks as it needs.
        (
            rows.withColumn("month", _month(F.col("workout_date"))).withColumn("version", F.lit(version))
            .repartitionByRange("month", "user_id", "workout_date", "workout_id")
            .sortWithinPartitions("month", "user_id", "workout_date", "workout_id", "exercise_id", "set_number")
            .write.mode("append").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy("month", "version")
            .parquet(f"{self.path}/data")
        )
        written = {m.removeprefix("month="): version for m in self.manifest.children(f"{self.path}/data")
                   if f"version={version}" in self.manifest.children(f"{self.path}/data/{m}")}
        self.manifest.publish({"months": {**kept, **written}})
        self._vacuum()

    def write(self, rows: DataFrame) -> None:
        """Replace the whole log."""
        self._put(rows, {})

    def replace_users(self, history: DataFrame, users: DataFrame | None = None) -> None:
        """Drop everything of some users (by default those of ``history``) and put the given rows in place.

        Only the months that hold rows of these users, before or after, are read and written again.
        """
        given = history.to(_schema(self.spark))
        gone = (given if users is None else users).select("user_id").distinct()
        mine = self.read().join(gone, "user_id", "left_semi").select("month")
        touched = {r["month"] for r in mine.union(given.select(_month(F.col("workout_date")))).distinct().collect()}
        months = self.months()
        old = self._read({m: v for m, v in months.items() if m in touched})
        rows = old.drop("month").join(gone, "user_id", "left_anti").unionByName(given)
        self._put(rows, {m: v for m, v in months.items() if m not in touched})

    def read(self, users=None, start=None, end=None) -> DataFrame:
        """Rows of some users (an id, a list, a frame) and days; others are pruned by folder and by file statistics."""
        low, high = ((str(d)[:7] if d is not None else None) for d in (start, end))
        months = {m: v for m, v in self.months().items() if (low is None or m >= low) and (high is None or m <= high)}
        rows = self._read(months)
        if start is not None:
            rows = rows.where((F.col("month") >= low) & (F.col("workout_date") >= F.lit(start).cast("date")))
        if end is not None:
            rows = rows.where((F.col("month") <= high) & (F.col("workout_date") <= F.lit(end).cast("date")))
        return for_users(rows, users)

    def _read(self, months: dict[str, str]) -> DataFrame:
        schema = f"{COLUMNS}, month string"
        if not months:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/month={m}/version={v}" for m, v in sorted(months.items())]
        return self.spark.read.schema(f"{schema}, version string").option("basePath", f"{self.path}/data").parquet(*paths).drop("version")

    def tables(self, t, start=None, end=None):
        """Tables whose log operators read this log instead of joining sets to workouts."""
        return t.replaced(flat_log=self.read(start=start, end=end))

    def _vacuum(self) -> None:
        """Delete versions that no kept manifest names."""
        named = {(m, v) for n in self.manifest.versions() for m, v in self.manifest.load(n).get("months", {}).items()}
        for month in self.manifest.children(f"{self.path}/data"):
            for version in self.manifest.children(f"{self.path}/data/{month}"):
                if (month.removeprefix("month="), version.removeprefix("version=")) not in named:
                    self.manifest.remove(f"{self.path}/data/{month}/{version}")


def _month(day):
    return F.date_format(day, "yyyy-MM")
