"""Progress over time: top sets, tonnage, records and session counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.functions import rules
from liftlake.operators.common import for_users, log_join, workouts_of


def scan_log(t, users=None, start=None, end=None) -> DataFrame:
    """Sets with their workout; user and date filters reach the file scan.

    A flat log is read as it is, without a join.
    """
    out = ["user_id", "workout_id", "workout_date", "split_focus", "exercise_id", "set_number",
           F.col("weight_kg").cast("double").alias("weight_kg"), "reps"]
    if "flat_log" in t:
        rows = for_users(t["flat_log"], users)
        if start is not None:
            rows = rows.where((F.col("month") >= str(start)[:7]) & (F.col("workout_date") >= F.lit(start).cast("date")))
        if end is not None:
            rows = rows.where((F.col("month") <= str(end)[:7]) & (F.col("workout_date") <= F.lit(end).cast("date")))
        return rows.select(*out)
    w = workouts_of(t, users)
    if start is not None:
        w = w.where(F.col("workout_date") >= F.lit(start).cast("date"))
    if end is not None:
        w = w.where(F.col("workout_date") <= F.lit(end).cast("date"))
    w = w.select("workout_id", "user_id", "workout_date", "split_focus")
    return t["workout_sets"].join(w, "workout_id").select(*out)


def full_join(t, users=None) -> DataFrame:
    """Workouts, sets and exercises in one row per set."""
    return log_join(t, users).join(t["exercises"], "exercise_id").select(
        "user_id", "workout_id", "workout_date", "slug", "name", "muscle_group",
        "set_number", F.col("weight_kg").cast("double").alias("weight_kg"), "reps",
    )


def _with_slug(df: DataFrame, t, slug=None) -> DataFrame:
    if "slug" in df.columns:
        return df.drop("exercise_id")
    e = t["exercises"].select("exercise_id", "slug")
    if slug is not None:
        e = e.where(F.col("slug") == slug)
    return df.join(e, "exercise_id").drop("exercise_id")


def _sets_of(t, users, slug) -> DataFrame:
    """Sets with user and date; a slug filter is applied before anything is shuffled."""
    sets = log_join(t, users, named=True)
    if "slug" in sets.columns:
        return sets.where(F.col("slug").isNotNull() if slug is None else F.col("slug") == slug)
    if slug is not None:
        sets = sets.join(t["exercises"].where(F.col("slug") == slug).select("exercise_id"), "exercise_id")
    return sets


def session_points(t, users=None, slug=None) -> DataFrame:
    """Chart points per (user, exercise, date): top set and tonnage from one pass over the sets.

    Two aggregations with map-side combine replace the join of the sets to their
    own maximum; the second sees one row per weight.
    """
    return points_of(t, weight_partials(_sets_of(t, users, slug)))


def weight_partials(sets: DataFrame) -> DataFrame:
    """Sets of one weight per (user, exercise, date): most reps, number of sets, sum of reps."""
    return sets.groupBy(*_day(sets), "weight_kg").agg(
        F.max("reps").alias("reps"), F.count(F.lit(1)).alias("n"), F.sum("reps").alias("all_reps"))


def _day(sets: DataFrame) -> list[str]:
    return ["user_id", "exercise_id", "workout_date", *(["slug"] if "slug" in sets.columns else [])]


def points_of(t, per_weight: DataFrame) -> DataFrame:
    """Chart points out of the partial sums per weight."""
    points = per_weight.groupBy(*_day(per_weight)).agg(
        F.max("weight_kg").alias("max_weight"),
        F.max_by("reps", "weight_kg").alias("reps"),
        F.max_by("n", "weight_kg").alias("sets_count"),
        F.sum(F.col("weight_kg") * F.col("all_reps")).alias("tonnage"),
        F.sum("n").alias("all_sets"),
    )
    return _with_slug(points, t).select(
        "user_id", "slug", "workout_date", F.col("max_weight").cast("double").alias("max_weight"), "reps",
        "sets_count", F.col("tonnage").cast("double").alias("tonnage"), "all_sets")


def exercise_progress(t, users=None, slug=None) -> DataFrame:
    """Top set per (user, exercise, date): max weight, most reps at it, number of such sets."""
    return session_points(t, users, slug).select(
        "user_id", "slug", "workout_date", "max_weight", "reps", "sets_count")


def exercise_tonnage(t, users=None, slug=None) -> DataFrame:
    """Sum of weight x reps and number of sets per (user, exercise, date)."""
    sets = _sets_of(t, users, slug)
    per_day = sets.groupBy(*_day(sets)).agg(
        F.sum(F.col("weight_kg") * F.col("reps")).alias("tonnage"),
        F.count(F.lit(1)).alias("sets_count"),
    )
    return _with_slug(per_day, t).select(
        "user_id", "slug", "workout_date", F.col("tonnage").cast("double").alias("tonnage"), "sets_count")


def tonnage_display(t, users=None) -> DataFrame:
    """Tonnage rounded to whole kilograms for display."""
    return exercise_tonnage(t, users).select(
        "user_id", "slug", "workout_date",
        F.round(F.col("tonnage").cast("decimal(18,4)"), 0).cast("bigint").alias("tonnage_kg"))


def exercise_records(t, users=None) -> DataFrame:
    """Per (user, exercise): earliest top-weight session, earliest top-tonnage session, latest session."""
    points = session_points(t, users)
    earliest = -F.datediff("workout_date", F.lit("1970-01-01").cast("date"))
    point = F.struct("workout_date", "max_weight", "reps", "sets_count", "tonnage")
    best = points.groupBy("user_id", "slug").agg(
        F.max_by(point, F.struct("max_weight", earliest)).alias("w"),
        F.max_by(point, F.struct("tonnage", earliest)).alias("t"),
        F.max_by(point, "workout_date").alias("l"),
    )
    return best.select(
        "user_id", "slug",
        F.col("w.workout_date").alias("weight_pr_date"), F.col("w.max_weight").alias("weight_pr"),
        F.col("w.reps").alias("weight_pr_reps"), F.col("w.sets_count").alias("weight_pr_sets"),
        F.col("t.workout_date").alias("tonnage_pr_date"), F.col("t.tonnage").alias("tonnage_pr"),
        F.col("l.workout_date").alias("latest_date"), F.col("l.max_weight").alias("latest_weight"),
        F.col("l.reps").alias("latest_reps"), F.col("l.sets_count").alias("latest_sets"),
        F.col("l.tonnage").alias("latest_tonnage"),
    )


def recent_sessions(t, users=None, n: int = 8) -> DataFrame:
    """The last ``n`` top sets per (user, exercise), newest first, with their labels."""
    w = Window.partitionBy("user_id", "slug").orderBy(F.desc("workout_date"))
    last = (
        exercise_progress(t, users).withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= n)
    )
    return _with_kind(t, last).select(
        "user_id", "slug", "position", "workout_date", "max_weight", "reps", "sets_count",
        rules.session_point_label(
            F.col("bodyweight"), F.col("max_weight"), F.col("reps"), F.col("sets_count")).alias("label"),
    )


def _with_kind(t, points: DataFrame) -> DataFrame:
    """Points with the flag of bodyweight exercises."""
    return points.join(
        t["exercises"].select("slug", rules.is_bodyweight(F.col("equipment")).alias("bodyweight")), "slug")


def all_zero_weight(t, users=None) -> DataFrame:
    """Does a bodyweight exercise chart reps because no session was loaded?"""
    return _with_kind(t, exercise_progress(t, users)).groupBy("user_id", "slug", "bodyweight").agg(
        F.bool_and(F.col("max_weight") == 0).alias("all_zero")
    ).select("user_id", "slug", "bodyweight", "all_zero",
             (F.col("bodyweight") & F.col("all_zero")).alias("reps_mode"))


def chart_domain(t, users=None) -> DataFrame:
    """Axis ranges per series: weight (or reps) widened by 2, tonnage by 5."""
    points = _with_kind(t, session_points(t, users))
    agg = points.groupBy("user_id", "slug", "bodyweight").agg(
        F.bool_and(F.col("max_weight") == 0).alias("all_zero"),
        F.min("max_weight").alias("w_lo"), F.max("max_weight").alias("w_hi"),
        F.min("reps").alias("r_lo"), F.max("reps").alias("r_hi"),
        F.min("tonnage").alias("t_lo"), F.max("tonnage").alias("t_hi"),
    )
    reps_mode = F.col("bodyweight") & F.col("all_zero")
    return agg.select(
        "user_id", "slug", reps_mode.alias("reps_mode"),
        (F.when(reps_mode, F.col("r_lo").cast("double")).otherwise(F.col("w_lo")) - 2).alias("top_low"),
        (F.when(reps_mode, F.col("r_hi").cast("double")).otherwise(F.col("w_hi")) + 2).alias("top_high"),
        (F.col("t_lo") - 5).alias("tonnage_low"), (F.col("t_hi") + 5).alias("tonnage_high"),
    )


def _trained_days(t, users=None) -> DataFrame:
    """Distinct (user, exercise, date); sets of a day collapse before the exercise is looked up."""
    return log_join(t, users).select("user_id", "exercise_id", "workout_date").distinct()


def muscle_group_sessions(t, users=None) -> DataFrame:
    """Number of distinct training dates per (user, muscle group)."""
    e = t["exercises"].where("muscle_group is not null and muscle_group <> ''").select("exercise_id", "muscle_group")
    return (
        _trained_days(t, users).join(e, "exercise_id")
        .groupBy("user_id", "muscle_group")
        .agg(F.countDistinct("workout_date").alias("session_count"))
    )


def exercise_sessions(t, users=None, muscle=None) -> DataFrame:
    """Number of distinct training dates per (user, exercise)."""
    e = t["exercises"].select("exercise_id", "slug", "name", "muscle_group")
    if muscle is not None:
        e = e.where(F.col("muscle_group") == muscle)
    counts = _trained_days(t, users).groupBy("user_id", "exercise_id").agg(F.count(F.lit(1)).alias("session_count"))
    return counts.join(e, "exercise_id").select("user_id", "muscle_group", "slug", "name", "session_count")


def session_labels(t, users=None) -> DataFrame:
    return exercise_sessions(t, users).select(
        "user_id", "slug", "session_count", rules.session_label(F.col("session_count")).alias("label"))


def trained_exercises(t, users=None) -> DataFrame:
    """Exercises of the catalog the user has logged at least one set of."""
    pairs = log_join(t, users).select("user_id", "exercise_id").distinct()
    return pairs.join(t["exercises"].select("exercise_id", "slug", "name", "muscle_group"), "exercise_id").select(
        "user_id", "slug", "name", "muscle_group")


def last_trained_date(t, users=None) -> DataFrame:
    """Latest date with at least one set, per user."""
    w = for_users(t["workouts"], users).select("workout_id", "user_id", "workout_date")
    with_sets = w.join(t["workout_sets"].select("workout_id"), "workout_id", "left_semi")
    return with_sets.groupBy("user_id").agg(F.max("workout_date").alias("last_date"))


def history_window(t, users=None, limit: int = 50) -> DataFrame:
    """The oldest ``limit`` workouts of each user.

    The limit is the feature: reports are built over this window. Spark keeps at
    most ``limit`` rows per user on the map side before the shuffle.
    """
    w = Window.partitionBy("user_id").orderBy("workout_date", "created_at", "workout_id")
    return (
        for_users(t["workouts"], users)
        .select("workout_id", "user_id", "workout_date", "created_at", "split_focus")
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= limit)
    )


def focus_counts(t, users=None, limit: int = 50, window: DataFrame | None = None) -> DataFrame:
    """Workouts per focus within the history window (given, or that of the users), most frequent first."""
    focus = F.coalesce(F.nullif(F.col("split_focus"), F.lit("")), F.lit("Unknown"))
    counts = (
        (history_window(t, users, limit) if window is None else window)
        .groupBy("user_id", focus.alias("focus"))
        .agg(F.count(F.lit(1)).alias("workouts"))
    )
    per_user = Window.partitionBy("user_id")
    chest = F.when(F.lower("focus").contains("chest"), F.col("workouts")).otherwise(0)
    return counts.select(
        "user_id", "focus", "workouts",
        F.sum(chest).over(per_user).alias("chest_related"),
        F.row_number().over(per_user.orderBy(F.desc("workouts"), "focus")).alias("position"),
    )
