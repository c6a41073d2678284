"""Last logs, day overviews and pickers."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.functions import rules
from liftlake.operators.common import exercise_logs, for_users, log_join, newest
from liftlake.operators.history import last_trained_date


def _catalog(t) -> DataFrame:
    return t["exercises"].select(
        "exercise_id", "slug", "name", "muscle_group", rules.is_bodyweight(F.col("equipment")).alias("bodyweight"))


def last_exercise_log(t, users=None, slug=None, cap: int | None = None) -> DataFrame:
    """Newest workout with the exercise: its first set and set count.

    ``cap`` searches only the newest workouts of a user (the chat rule uses 40).
    """
    recent = None
    if cap is not None:
        recent = (
            for_users(t["workouts"], users)
            .select("workout_id", "user_id", "workout_date", "created_at")
            .withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(
                F.desc("workout_date"), F.desc("created_at"), F.desc("workout_id"))))
            .where(F.col("n") <= cap)
        )
    logs = exercise_logs(t, users, recent)
    named = "slug" in logs.columns
    if named and slug is not None:
        logs = logs.where(F.col("slug") == slug)
    last = logs.groupBy("user_id", "exercise_id", *(["slug"] if named else [])).agg(
        F.max_by(F.struct("workout_date", "first_weight", "first_reps", "sets_count"), newest()).alias("last"))
    if not named:
        e = t["exercises"].select("exercise_id", "slug")
        last = last.join(e if slug is None else e.where(F.col("slug") == slug), "exercise_id")
    return last.select(
        "user_id", "slug",
        F.col("last.workout_date").alias("workout_date"),
        F.col("last.first_weight").cast("double").alias("weight_kg"),
        F.col("last.first_reps").alias("reps"),
        F.col("last.sets_count").alias("sets_count"),
    )


def repeat_last(t, users=None, cap: int | None = None) -> DataFrame:
    """Next form entry proposed from the last log; unloaded bodyweight leaves the weight blank."""
    last = last_exercise_log(t, users, cap=cap)
    e = t["exercises"].select("slug", rules.is_bodyweight(F.col("equipment")).alias("bodyweight"))
    blank = F.col("bodyweight") & (F.col("weight_kg") == 0)
    return last.join(e, "slug").select(
        "user_id", "slug",
        F.when(blank, "").otherwise(rules.plain_number(F.col("weight_kg"))).alias("weight_text"),
        rules.plain_number(F.col("reps")).alias("reps_text"),
        rules.plain_number(F.col("sets_count")).alias("sets_text"),
        F.concat_ws("×", rules.general_number(F.col("weight_kg")), F.col("reps").cast("string"),
                    F.col("sets_count").cast("string")).alias("button_text"),
    )


def newest_workout_per_exercise(t, users=None, workouts: DataFrame | None = None) -> DataFrame:
    """Newest workout of each (user, exercise, date), where a date holds several."""
    logs = exercise_logs(t, users, workouts)
    best = logs.groupBy("user_id", "exercise_id", "workout_date").agg(
        F.max_by(F.struct("workout_id", "min_weight", "min_reps", "sets_count"),
                 F.struct("created_at", "workout_id")).alias("last"))
    return best.select(
        "user_id", "exercise_id", "workout_date", F.col("last.workout_id").alias("workout_id"),
        F.col("last.min_weight").cast("double").alias("weight_kg"),
        F.col("last.min_reps").alias("reps"), F.col("last.sets_count").alias("sets_count"))


def last_workout_summary(t, users=None) -> DataFrame:
    """Everything a user did on the last training date.

    The focus is that of the newest workout of the date naming one, even if it holds no sets.
    """
    # Per exercise, the log of its own last date; only rows on the user's last date stay.
    last = exercise_logs(t, users).groupBy("user_id", "exercise_id").agg(
        F.max_by(F.struct("workout_date", "first_weight", "first_reps", "sets_count"), newest()).alias("last"))
    last_date = last.groupBy("user_id").agg(F.max("last.workout_date").alias("workout_date"))
    focus = F.trim("split_focus")
    named = (
        for_users(t["workouts"], users)
        .where((focus != "") & (F.col("split_focus") != "Logged"))
        .groupBy("user_id", "workout_date")
        .agg(F.max_by(focus, F.struct("created_at", "workout_id")).alias("split_focus"))
    )
    day = last_date.join(named, ["user_id", "workout_date"], "left")
    return (
        last.join(day, "user_id")
        .where(F.col("last.workout_date") == F.col("workout_date"))
        .join(_catalog(t), "exercise_id")
        .select(
            "user_id", "workout_date", "split_focus", "slug", "name", "muscle_group",
            F.col("last.first_weight").cast("double").alias("weight_kg"),
            F.col("last.first_reps").alias("reps"),
            F.col("last.sets_count").alias("sets_count"),
        )
    )


def summary_titles(t, users=None) -> DataFrame:
    """Title and exercise lines of the last workout card."""
    e = t["exercises"].select("slug", rules.is_bodyweight(F.col("equipment")).alias("bodyweight"))
    return last_workout_summary(t, users).join(e, "slug").select(
        "user_id", "slug",
        rules.summary_title(F.col("workout_date"), F.col("split_focus")).alias("title"),
        rules.set_label(F.col("bodyweight"), F.col("weight_kg"), F.col("reps"), F.col("sets_count")).alias("line"),
    )


def user_exercises(t, users=None, muscle=None) -> DataFrame:
    """Each registered user with each catalog exercise, whatever its muscle group.

    The catalog, a dimension of bounded size, is expanded inside each user's row.
    """
    e = _catalog(t)
    if muscle is not None:
        e = e.where(F.col("muscle_group") == muscle)
    catalog = e.agg(F.collect_list(F.struct(*e.columns))).scalar()
    return for_users(t["profile"], users).select("user_id", F.inline(catalog))


def _as_of(t, as_of, users) -> DataFrame:
    """Per-user day as a frame (user_id, as_of); the default is the last trained date."""
    if as_of is None:
        return last_trained_date(t, users).withColumnRenamed("last_date", "as_of")
    if isinstance(as_of, DataFrame):
        return for_users(as_of, users)
    raise TypeError("as_of: a date, a DataFrame (user_id, as_of) or None")


def _logged_on(t, as_of, users) -> DataFrame:
    """Minima of the newest workout per (user, exercise) on the user's day."""
    if isinstance(as_of, (str, datetime.date)):
        day = t["workouts"].where(F.col("workout_date") == F.lit(as_of).cast("date"))
    else:
        day = t["workouts"].join(_as_of(t, as_of, users), "user_id").where("workout_date = as_of")
    return newest_workout_per_exercise(t, users, day).select(
        "user_id", "exercise_id",
        F.col("weight_kg").alias("last_weight_kg"), F.col("reps").alias("last_reps"),
        F.col("sets_count").alias("last_sets_count"), F.lit(True).alias("logged"))


def today_overview(t, as_of=None, users=None) -> DataFrame:
    """Planned exercises of the day among those ever trained, with what is logged already.

    A user without a plan for the weekday gets no rows. ``position`` is the
    display order: logged first, then by name.
    """
    split = for_users(t["training_split"], users)
    if isinstance(as_of, (str, datetime.date)):
        split = split.withColumn("as_of", F.lit(as_of).cast("date"))
    else:
        split = split.join(_as_of(t, as_of, users), "user_id")
    plan = (
        split.where(F.col("day_label") == rules.day_label(F.col("as_of")))
        .groupBy("user_id", F.col("as_of").alias("workout_date"))
        .agg(F.min_by("focus", F.struct("sort_order", "focus")).alias("focus"))
    )
    trained = log_join(t, users).select("user_id", "exercise_id").distinct()
    suggested = (
        trained.join(plan, "user_id")
        .join(_catalog(t), "exercise_id")
        .where(F.array_contains(rules.plan_muscles(F.col("focus")), F.col("muscle_group")))
    )
    rows = suggested.join(_logged_on(t, as_of, users), ["user_id", "exercise_id"], "left").select(
        "user_id", "workout_date", "focus", "slug", "name", "muscle_group",
        F.coalesce("logged", F.lit(False)).alias("is_logged_today"),
        "last_weight_kg", "last_reps", "last_sets_count")
    order = Window.partitionBy("user_id").orderBy(F.desc("is_logged_today"), "name", "slug")
    return rows.withColumn("position", F.row_number().over(order))


def muscle_session_overview(t, as_of=None, users=None, muscle=None) -> DataFrame:
    """Every catalog exercise of a muscle group per user, trained or not.

    All groups of the catalog are covered, the null group too.
    """
    wanted = user_exercises(t, users, muscle)
    counts = (
        log_join(t, users).select("user_id", "exercise_id", "workout_date").distinct()
        .groupBy("user_id", "exercise_id").agg(F.count(F.lit(1)).alias("n"))
    )
    keys = ["user_id", "exercise_id"]
    rows = (
        wanted.join(counts, keys, "left")
        .join(_logged_on(t, as_of, users), keys, "left")
        .select(
            "user_id", "muscle_group", "slug", "name", "bodyweight",
            F.coalesce("n", F.lit(0).cast("bigint")).alias("session_count"),
            F.coalesce("logged", F.lit(False)).alias("is_logged_today"),
            "last_weight_kg", "last_reps", "last_sets_count")
    )
    order = Window.partitionBy("user_id", "muscle_group").orderBy(F.desc("session_count"), "name", "slug")
    return rows.withColumn("position", F.row_number().over(order))


def session_picker(t, as_of=None, users=None, top: int = 3) -> DataFrame:
    """Overview split into the most trained exercises and the rest, in display order."""
    is_top = (F.col("position") <= top) & (F.col("session_count") > 0)
    return muscle_session_overview(t, as_of, users).select(
        "user_id", "muscle_group", "slug", "name", "session_count",
        F.when(is_top, "top").otherwise("more").alias("section"), "position")


def picker_subtitles(t, as_of=None, users=None) -> DataFrame:
    return muscle_session_overview(t, as_of, users).select(
        "user_id", "muscle_group", "slug",
        rules.picker_subtitle(
            F.col("is_logged_today"), F.col("bodyweight"), F.col("last_weight_kg"), F.col("last_reps"),
            F.col("last_sets_count"), F.col("session_count")).alias("subtitle"))


def no_history_exercises(t, users=None) -> DataFrame:
    """Catalog exercises a registered user has never logged."""
    trained = log_join(t, users).select("user_id", "exercise_id").distinct()
    return (
        user_exercises(t, users)
        .join(trained, ["user_id", "exercise_id"], "left_anti")
        .select("user_id", "muscle_group", "slug", "name")
    )
