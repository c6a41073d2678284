"""Shared steps: user filters and the per-workout summary of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def for_users(df: DataFrame, users) -> DataFrame:
    """Keep some users: an id, a list of ids, or a DataFrame with ``user_id``."""
    if users is None:
        return df
    if isinstance(users, DataFrame):
        return df.join(users.select("user_id").distinct(), "user_id", "left_semi")
    if isinstance(users, int):
        return df.where(F.col("user_id") == users)
    return df.where(F.col("user_id").isin(list(users)))


def workouts_of(t, users=None) -> DataFrame:
    """Workouts of some users; tables that know how their files hold a user id get it as a filter of the scan."""
    if users is None or isinstance(users, DataFrame) or not hasattr(t, "of_users"):
        return for_users(t["workouts"], users)
    return for_users(t.of_users("workouts", [users] if isinstance(users, int) else list(users)), users)


def log_join(t, users=None, columns=("workout_date",), named: bool = False) -> DataFrame:
    """Sets with their workout's user and the given workout columns.

    Where the tables hold a flat log its rows are taken as they are, if ``named``
    with the slug that they carry.
    """
    if "flat_log" in t:
        return for_users(t["flat_log"], users).select(
            "workout_id", "exercise_id", "set_number", "weight_kg", "reps", "rpe", "user_id", *columns, *["slug"] * named)
    w = workouts_of(t, users).select("workout_id", "user_id", *columns)
    return t["workout_sets"].join(w, "workout_id")


# Days asked for that are looked up one by one in stored rows; beyond, their range is.
MAX_LISTED_DAYS = 400


def listed_days(touched: DataFrame, name: str = "workout_date"):
    """Predicate on a date column that prunes stored days: a list while it is short, else a range."""
    days = [r[0] for r in touched.select("workout_date").distinct().limit(MAX_LISTED_DAYS + 1).collect()]
    if len(days) <= MAX_LISTED_DAYS:
        return F.col(name).isin(days)
    low, high = touched.agg(F.min("workout_date"), F.max("workout_date")).first()
    return F.col(name).between(low, high)


def on_days(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of the (user_id, workout_date) pairs; partitions and files of other days are not read."""
    kept = rows.where(listed_days(touched))
    if "month" in rows.columns:
        months = [r[0] for r in touched.select(F.date_format("workout_date", "yyyy-MM")).distinct().collect()]
        kept = kept.where(F.col("month").isin(months))
    return kept.join(touched, ["user_id", "workout_date"], "left_semi").select(*rows.columns)


def set_order():
    """First set of an exercise: lowest set number, then lightest, then fewest reps.

    One long (set number, weight in hundredths, reps) instead of a struct keeps the
    aggregation hash-based. Its fields hold more than the columns can: weights are
    decimal(6,2), reps and set numbers smallint; the key has room for 2^26 reps.
    """
    hundredths = (F.col("weight_kg") * 100).cast("bigint")
    return (F.col("set_number").cast("bigint") * 1_000_000 + hundredths) * 67_108_864 + F.col("reps")


def exercise_logs(t, users=None, workouts: DataFrame | None = None) -> DataFrame:
    """One row per (workout, exercise) with first set, minima and set count.

    Sets are reduced per workout before the join, so the join moves one row per
    exercise of a workout, and a crowded workout is combined on the map side. A flat
    log needs no join, and its rows keep the slug (sets outside the catalog go). Where
    ``users`` or ``workouts`` (a part of the workouts) restrict the log, other sets
    go before anything is aggregated.
    """
    flat = workouts is None and "flat_log" in t
    keys = ["workout_id", "exercise_id"]
    if flat:
        sets = log_join(t, users, ("workout_date", "created_at"), named=True).where("slug is not null")
        keys += ["user_id", "workout_date", "created_at", "slug"]
    else:
        w = (workouts_of(t, users) if workouts is None else for_users(workouts, users)).select(
            "workout_id", "user_id", "workout_date", "created_at")
        sets = t["workout_sets"]
        if users is not None or workouts is not None:
            sets = sets.join(w.select("workout_id"), "workout_id", "left_semi")
    per_exercise = sets.groupBy(*keys).agg(
        F.min_by("weight_kg", set_order()).alias("first_weight"),
        F.min_by("reps", set_order()).alias("first_reps"),
        F.min("weight_kg").alias("min_weight"),
        F.min("reps").alias("min_reps"),
        F.count(F.lit(1)).alias("sets_count"),
    )
    return per_exercise if flat else per_exercise.join(w, "workout_id")


def newest():
    """Order of workouts from old to new, with the id as tie-break."""
    return F.struct("workout_date", "created_at", "workout_id")


def one_per_key(df: DataFrame, keys: list[str], oldest=(), newest=()) -> DataFrame:
    """One row per key, the same in every run: the first by ``oldest`` columns, or the last by ``newest`` ones.

    Rows that these leave equal are told apart by all their values, so a repeated
    task cannot choose another one. Null keys form a group of their own.
    """
    values = [c for c in df.columns if c not in keys]
    if not values:
        return df.distinct()
    row = F.struct(*values)
    # Maps have no order; their text does.
    text = F.to_json(F.struct(*[F.struct(F.col(c).isNull().alias("no"), F.col(c).alias("value")).alias(c) for c in values]))
    pick, order = (F.max_by, newest) if newest else (F.min_by, oldest)
    chosen = df.groupBy(*keys).agg(pick(row, F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], text.alias("row"))).alias("v"))
    return chosen.select(*keys, "v.*").select(*df.columns)
