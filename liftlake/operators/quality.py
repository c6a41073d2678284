"""Declared constraints of the log as report jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: the declared constraints ---------------------------------
UNIQUE_KEYS = {
    "profile": ["user_id"],
    "exercises": ["slug"],
    "user_exercises": ["user_id", "exercise_id"],
    "workout_sets": ["workout_id", "exercise_id", "set_number"],
}
ALLOWED_VALUES = {
    "goals.horizon": ["short", "medium", "long"],
    "goals.status": ["active", "achieved", "paused"],
    "injuries.status": ["active", "recovering", "resolved"],
    "user_exercises.role": ["base", "accessory"],
}
RANGES = {"workouts.overall_rpe": (1, 10), "workout_sets.rpe": (1, 10)}
NOT_NULL = {
    "profile": ["user_id"],
    "goals": ["user_id", "horizon", "description", "status", "sort_order"],
    "injuries": ["user_id", "body_part", "status"],
    "exercise_bans": ["user_id", "exercise_name", "is_active"],
    "training_split": ["user_id", "day_label", "focus", "sort_order", "is_active"],
    "exercises": ["slug", "name"],
    "user_exercises": ["user_id", "exercise_id", "role"],
    "workouts": ["user_id", "workout_date", "created_at"],
    "workout_sets": ["workout_id", "exercise_id", "set_number", "weight_kg", "reps"],
}
FOREIGN_KEYS = [
    ("goals", "user_id", "profile", "user_id"),
    ("injuries", "user_id", "profile", "user_id"),
    ("exercise_bans", "user_id", "profile", "user_id"),
    ("training_split", "user_id", "profile", "user_id"),
    ("user_exercises", "user_id", "profile", "user_id"),
    ("user_exercises", "exercise_id", "exercises", "exercise_id"),
    ("user_exercises", "split_id", "training_split", "split_id"),
    ("workouts", "user_id", "profile", "user_id"),
    ("workout_sets", "workout_id", "workouts", "workout_id"),
    ("workout_sets", "exercise_id", "exercises", "exercise_id"),
]
DEFAULTS = {"status": "active", "sort_order": 0}
# ----------------------------------------------------------------------------


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dup_keys(t) -> DataFrame:
    """Key values stored more than once, with their number of rows."""
    parts = []
    for table, keys in UNIQUE_KEYS.items():
        dups = t[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(dups.select(
            F.lit(table).alias("table_name"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n"))
    return _union(parts)


def domain_violations(t) -> DataFrame:
    """Rows per rule and value outside the allowed values."""
    parts = []
    for rule, allowed in ALLOWED_VALUES.items():
        table, column = rule.split(".")
        bad = t[table].where(~F.col(column).isin(allowed))
        parts.append(bad.groupBy(F.lit(rule).alias("rule"), F.col(column).alias("value")).agg(
            F.count(F.lit(1)).alias("n")))
    return _union(parts)


def range_violations(t) -> DataFrame:
    """Rows per rule and value outside the declared range; null passes."""
    parts = []
    for rule, (low, high) in RANGES.items():
        table, column = rule.split(".")
        bad = t[table].where(~F.col(column).between(low, high))
        parts.append(bad.groupBy(F.lit(rule).alias("rule"), F.col(column).alias("value")).agg(
            F.count(F.lit(1)).alias("n")))
    return _union(parts)


def null_violations(t) -> DataFrame:
    """Null count of every column declared not null, one pass per table."""
    parts = []
    for table, columns in NOT_NULL.items():
        counts = t[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        pairs = ", ".join(f"'{table}.{c}', `{c}`" for c in columns)
        parts.append(counts.select(F.expr(f"stack({len(columns)}, {pairs}) as (column_name, nulls)")))
    return _union(parts)


def orphan_rows(t) -> DataFrame:
    """Rows per foreign key whose parent is missing."""
    parts = []
    for child, column, parent, parent_column in FOREIGN_KEYS:
        keys = t[parent].select(F.col(parent_column).alias("parent_key")).distinct()
        orphans = t[child].where(F.col(column).isNotNull()).join(
            keys, F.col(column) == F.col("parent_key"), "left_anti")
        parts.append(orphans.agg(F.count(F.lit(1)).alias("orphans")).select(
            F.lit(f"{child}.{column}").alias("foreign_key"), "orphans"))
    return _union(parts)


def visible_workouts(t) -> DataFrame:
    """Workouts of registered users."""
    return t["workouts"].join(t["profile"].select("user_id"), "user_id", "left_semi")


def visible_rows(t) -> DataFrame:
    """Sets whose workout is visible."""
    return t["workout_sets"].join(visible_workouts(t).select("workout_id"), "workout_id", "left_semi")


def with_defaults(rows: DataFrame, as_of=None) -> DataFrame:
    """Fill the declared column defaults; a missing workout date becomes ``as_of``."""
    values = {**DEFAULTS, "role": "base", "is_active": True}
    for column, value in values.items():
        if column in rows.columns:
            rows = rows.withColumn(column, F.coalesce(column, F.lit(value)))
    if as_of is not None and "workout_date" in rows.columns:
        rows = rows.withColumn("workout_date", F.coalesce("workout_date", F.lit(as_of).cast("date")))
    return rows


def catalog_drift(dictionary: DataFrame, table: DataFrame) -> DataFrame:
    """Differences between the alias dictionary and the exercise table."""
    d = dictionary.select("slug", F.col("canonical").alias("dict_name"), F.col("muscle_group").alias("dict_muscle"),
                          F.lit(True).alias("in_dict"))
    e = table.select("slug", F.col("name").alias("table_name"), F.col("muscle_group").alias("table_muscle"),
                     F.lit(True).alias("in_table"))
    kind = (
        F.when(F.col("in_table").isNull(), "only_in_dictionary")
        .when(F.col("in_dict").isNull(), "only_in_table")
        .when(~F.col("dict_name").eqNullSafe(F.col("table_name")), "name_differs")
        .when(~F.col("dict_muscle").eqNullSafe(F.col("table_muscle")), "muscle_differs")
    )
    return d.join(e, "slug", "full_outer").withColumn("drift", kind).where("drift is not null").select(
        "slug", "drift", "dict_name", "table_name")
