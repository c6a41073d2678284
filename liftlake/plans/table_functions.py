"""SQL table functions over the results, for callers that ask for one user at a time.

``register_functions`` publishes the results as views and puts a function with
parameters before each. A function's filters go through the view to the scan.
Columns and parameters follow the app's questions: user, exercise or muscle group,
day. ``log_exercise_session`` answers what a save would do; the save itself is
``writes.log_sessions``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from liftlake.functions import rules
from liftlake.operators import history, sessions
from liftlake.operators.writes import CANDIDATE_WORKOUTS, CONTINUE_HOURS, FOCUS_VARIANTS, IN_PROGRESS

# --- Fixed values: the exercise of the shortcut function ---------------------
BENCH_SLUG = "bench_press"
# ----------------------------------------------------------------------------


def _views(t) -> dict:
    slugs = t["exercises"].select("exercise_id", "slug")
    return {
        "log_exercises": t["exercises"].select(
            "slug", "name", "muscle_group", rules.is_bodyweight(F.col("equipment")).alias("bodyweight"), "exercise_id"),
        "log_progress": history.exercise_progress(t),
        "log_tonnage": history.exercise_tonnage(t),
        "log_muscle_groups": history.muscle_group_sessions(t),
        "log_exercise_sessions": history.exercise_sessions(t),
        "log_last": sessions.last_exercise_log(t),
        "log_last_summary": sessions.last_workout_summary(t),
        "log_days": sessions.newest_workout_per_exercise(t).join(slugs, "exercise_id").drop("exercise_id"),
        "log_plan": t["training_split"].select("user_id", "day_label", "focus", "sort_order"),
        "log_workouts": t["workouts"].select("workout_id", "user_id", "workout_date", "split_focus", "created_at"),
        "log_sets": t["workout_sets"].select("workout_id", "exercise_id"),
    }


def _case(column: str, mapping: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {other} END"


def _plan_day(day: str) -> str:
    return f"CASE WHEN weekday({day}) < 2 THEN 'Mon/Tue' WHEN weekday({day}) < 4 THEN 'Wed/Thu' ELSE 'Fri/Sat' END"


def _planned(focus: str) -> str:
    array = lambda values: "array(" + ", ".join(f"'{v}'" for v in values) + ")"
    cases = " ".join(f"WHEN '{k}' THEN {array(v)}" for k, v in rules.PLAN_MUSCLES.items())
    return f"CASE {focus} {cases} ELSE {array(rules.MUSCLE_ORDER)} END"


def _functions() -> dict[str, tuple[str, str, str]]:
    """Name -> (parameters, columns, query)."""
    point = "workout_date DATE, max_weight DOUBLE, reps INT, sets_count BIGINT"
    last = "last_weight_kg DOUBLE, last_reps INT, last_sets_count BIGINT"
    fits = f"w.split_focus = c.focus OR w.split_focus = '{rules.FOCUS_UNKNOWN}'" + "".join(
        f" OR (c.focus = '{focus}' AND w.split_focus IN ({', '.join(repr(v) for v in variants)}))" for focus, variants in FOCUS_VARIANTS.items())
    return {
        "user_muscle_groups": (
            "p_user BIGINT", "muscle_group STRING, session_count BIGINT",
            "SELECT muscle_group, session_count FROM log_muscle_groups WHERE user_id = p_user"),
        "user_exercises_for_muscle": (
            "p_user BIGINT, p_muscle STRING", "slug STRING, name STRING, session_count BIGINT",
            "SELECT slug, name, session_count FROM log_exercise_sessions WHERE user_id = p_user AND muscle_group = p_muscle"),
        "exercise_progress": (
            "p_user BIGINT, p_slug STRING", point,
            "SELECT workout_date, max_weight, reps, sets_count FROM log_progress WHERE user_id = p_user AND slug = p_slug"),
        "bench_press_progress": (
            "p_user BIGINT", point,
            f"SELECT workout_date, max_weight, reps, sets_count FROM log_progress WHERE user_id = p_user AND slug = '{BENCH_SLUG}'"),
        "exercise_tonnage": (
            "p_user BIGINT, p_slug STRING", "workout_date DATE, tonnage DOUBLE, sets_count BIGINT",
            "SELECT workout_date, tonnage, sets_count FROM log_tonnage WHERE user_id = p_user AND slug = p_slug"),
        "last_exercise_log": (
            "p_user BIGINT, p_slug STRING", "workout_date DATE, weight_kg DOUBLE, reps INT, sets_count BIGINT",
            "SELECT workout_date, weight_kg, reps, sets_count FROM log_last WHERE user_id = p_user AND slug = p_slug"),
        "last_workout_summary": (
            "p_user BIGINT", "workout_date DATE, split_focus STRING, slug STRING, name STRING, muscle_group STRING, "
            "weight_kg DOUBLE, reps INT, sets_count BIGINT",
            "SELECT workout_date, split_focus, slug, name, muscle_group, weight_kg, reps, sets_count FROM log_last_summary "
            "WHERE user_id = p_user"),
        "muscle_session_overview": (
            "p_user BIGINT, p_muscle STRING, p_day DATE DEFAULT current_date()",
            f"slug STRING, name STRING, muscle_group STRING, session_count BIGINT, is_logged_today BOOLEAN, {last}",
            """WITH counts AS (SELECT slug, session_count FROM log_exercise_sessions WHERE user_id = p_user),
                    today AS (SELECT slug, weight_kg, reps, sets_count FROM log_days WHERE user_id = p_user AND workout_date = p_day)
               SELECT e.slug, e.name, e.muscle_group, coalesce(c.session_count, 0), d.slug IS NOT NULL, d.weight_kg, d.reps, d.sets_count
               FROM log_exercises e LEFT JOIN counts c ON c.slug = e.slug LEFT JOIN today d ON d.slug = e.slug
               WHERE e.muscle_group = p_muscle"""),
        "today_workout_overview": (
            "p_user BIGINT, p_day DATE",
            f"focus STRING, slug STRING, name STRING, muscle_group STRING, is_logged_today BOOLEAN, {last}",
            f"""WITH plan AS (SELECT min_by(focus, struct(sort_order, focus)) AS focus FROM log_plan
                              WHERE user_id = p_user AND day_label = {_plan_day('p_day')} HAVING count(*) > 0),
                     trained AS (SELECT slug FROM log_exercise_sessions WHERE user_id = p_user),
                     today AS (SELECT slug, weight_kg, reps, sets_count FROM log_days WHERE user_id = p_user AND workout_date = p_day)
                SELECT p.focus, e.slug, e.name, e.muscle_group, d.slug IS NOT NULL, d.weight_kg, d.reps, d.sets_count
                FROM plan p JOIN log_exercises e ON array_contains({_planned('p.focus')}, e.muscle_group)
                JOIN trained t ON t.slug = e.slug LEFT JOIN today d ON d.slug = e.slug"""),
        "log_exercise_session": (
            "p_user BIGINT, p_slug STRING, p_weight DOUBLE, p_reps INT, p_sets INT, p_day DATE DEFAULT current_date(), "
            "p_now TIMESTAMP_NTZ DEFAULT localtimestamp()",
            "workout_id STRING, replaced BOOLEAN, split_focus STRING, reason STRING",
            f"""WITH c AS (
                  SELECT exercise_id, {_case('muscle_group', rules.FOCUS_APP, f"'{rules.FOCUS_UNKNOWN}'")} AS focus,
                         CASE WHEN coalesce(p_sets <= 0, true) THEN 'bad_sets' WHEN coalesce(p_reps <= 0, true) THEN 'bad_reps'
                              WHEN coalesce(p_weight < 0, true) THEN 'bad_weight' WHEN slug IS NULL THEN 'unknown_exercise'
                              WHEN p_weight = 0 AND NOT bodyweight THEN 'zero_weight' END AS reason
                  FROM (SELECT max(exercise_id) AS exercise_id, max(slug) AS slug, max(muscle_group) AS muscle_group,
                               max(bodyweight) AS bodyweight FROM log_exercises WHERE slug = p_slug)),
                day AS (SELECT workout_id, split_focus, created_at FROM log_workouts WHERE user_id = p_user AND workout_date = p_day
                        ORDER BY created_at DESC, workout_id DESC LIMIT {CANDIDATE_WORKOUTS}),
                found AS (
                  SELECT c.exercise_id, c.focus, c.reason,
                         max_by(w.workout_id, struct(w.created_at, w.workout_id)) FILTER (WHERE {fits}) AS same,
                         max_by(w.workout_id, struct(w.created_at, w.workout_id)) AS newest,
                         max_by(w.split_focus, struct(w.created_at, w.workout_id)) AS newest_focus, max(w.created_at) AS newest_at
                  FROM c LEFT JOIN day w ON true GROUP BY c.exercise_id, c.focus, c.reason),
                kept AS (
                  SELECT exercise_id, focus, reason, coalesce(same, CASE WHEN p_day = to_date(p_now) AND newest_focus = '{IN_PROGRESS}'
                         AND p_now <= newest_at + INTERVAL {CONTINUE_HOURS} HOURS THEN newest END) AS kept FROM found),
                sets AS (SELECT DISTINCT workout_id, exercise_id FROM log_sets)
                SELECT CASE WHEN k.reason IS NULL THEN coalesce(string(k.kept), concat_ws('|', p_user, p_day, k.focus)) END,
                       CASE WHEN k.reason IS NULL THEN s.workout_id IS NOT NULL END,
                       CASE WHEN k.reason IS NULL THEN k.focus END, k.reason
                FROM kept k LEFT JOIN sets s ON s.workout_id = k.kept AND s.exercise_id = k.exercise_id"""),
    }


def register_functions(spark: SparkSession, t) -> list[str]:
    """Publish the views and functions to the session; the functions' names."""
    for name, view in _views(t).items():
        view.createOrReplaceTempView(name)
    functions = _functions()
    for name, (parameters, columns, query) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {query}")
    return list(functions)
