"""Progress and tonnage kept up to date after a save, without reading the whole log again.

Partial sums per (user, exercise, date, weight) can be added up to chart points, and
a day's partial sums can be put in place of older ones. A save hands over the days
it touched; only their sets and their stored sums are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.operators.common import log_join, on_days
from liftlake.operators.history import points_of, weight_partials
from liftlake.sources.store import FAN, BatchStore

SCHEMA = ("user_id bigint, exercise_id bigint, workout_date date, weight_kg decimal(6,2), reps int, n bigint, all_reps bigint, "
          "month string")
KEYS = ["user_id", "exercise_id", "workout_date"]
_DAY = ["user_id", "workout_date"]


class SessionPartials:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.store = BatchStore(spark, path, SCHEMA, [*KEYS, "month"], partition_by=["month"], fan=fan)

    def save(self, batch_id: int, t, touched: DataFrame | None = None) -> bool:
        """Take over the days (user_id, workout_date) that a save touched, by default all of them.

        A key that has no sets any more gets a row without sets, which hides its old
        ones. False if the batch, or a later one, was taken over before.
        """
        sets = log_join(t)
        if touched is not None:
            touched = touched.select(*_DAY).distinct()
            t = t.replaced(**{name: on_days(t[name], touched) for name in ("flat_log" if "flat_log" in t else "workouts",)})
            sets = log_join(t)
        new = weight_partials(sets).withColumn("reps", F.col("reps").cast("int")).withColumn("month", F.date_format("workout_date", "yyyy-MM"))
        if touched is not None:
            months = touched.select(F.date_format("workout_date", "yyyy-MM").alias("month")).distinct()
            held = self.store.read(F.col("month").isin([r["month"] for r in months.collect()])).where("n > 0")
            keys = [*KEYS, "month"]
            lost = held.join(touched, _DAY, "left_semi").select(*keys).distinct().join(new.select(*keys), keys, "left_anti")
            new = new.unionByName(lost.withColumns({
                "weight_kg": F.lit(None).cast("decimal(6,2)"), "reps": F.lit(None).cast("int"),
                "n": F.lit(0).cast("bigint"), "all_reps": F.lit(0).cast("bigint")}))
        return self.store.commit(batch_id, new)

    def points(self, t) -> DataFrame:
        """Chart points as ``history.session_points`` gives them."""
        return points_of(t, self.store.read().where("n > 0").drop("month"))
