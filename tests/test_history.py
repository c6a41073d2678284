"""Golden values and edge cases of the history and session operators."""

import datetime as dt

from conftest import rows
from liftlake.operators import history, reports, sessions
from pyspark.sql import functions as F

D = dt.date.fromisoformat
EX = [
    (1, "bench_press", "Bench press", "chest", "barbell"),
    (2, "rope_pushdown", "Rope pushdown", "triceps", "cable"),
    (3, "rear_delt_fly", "Rear delt fly", "shoulders", "dumbbell"),
    (4, "pull_up", "Pull up", "back", "bodyweight"),
    (5, "odd", "Odd", None, None),
]
# (slug id, date, weight, reps) with three equal sets each
GOLDEN = [
    (1, "2026-06-03", 61, 6, 1098), (1, "2026-06-15", 61, 6, 1098), (1, "2026-06-17", 62, 6, 1116),
    (1, "2026-06-19", 63, 6, 1134), (1, "2026-06-23", 64, 6, 1152), (1, "2026-06-30", 65, 6, 1170),
    (1, "2026-07-07", 66, 6, 1188), (2, "2026-06-11", 30, 10, 900), (2, "2026-06-16", 32.5, 10, 975),
    (2, "2026-06-19", 32.5, 10, 975), (2, "2026-06-25", 33, 10, 990), (2, "2026-07-02", 35, 8, 840),
    (3, "2026-06-13", 7, 10, 210), (3, "2026-06-20", 7, 12, 252),
]


def golden(make):
    w = [(i, 900, d, "Chest + Biceps") for i, (_, d, _, _, _) in enumerate(GOLDEN)]
    s = [(i, e, n, float(kg), r) for i, (e, _, kg, r, _) in enumerate(GOLDEN) for n in (1, 2, 3)]
    return make(w, s, EX)


def test_progress_and_tonnage_goldens(make):
    t = golden(make)
    slug = {e[0]: e[1] for e in EX}
    got = rows(history.session_points(t), "slug", "workout_date", "max_weight", "reps", "sets_count", "tonnage", "all_sets")
    assert got == sorted(((slug[e], D(d), float(kg), r, 3, float(ton), 3) for e, d, kg, r, ton in GOLDEN), key=repr)


def test_records_goldens(make):
    got = {r["slug"]: r for r in history.exercise_records(golden(make)).collect()}
    assert (got["rope_pushdown"]["weight_pr"], got["rope_pushdown"]["weight_pr_date"]) == (35.0, D("2026-07-02"))
    assert (got["rope_pushdown"]["tonnage_pr"], got["rope_pushdown"]["tonnage_pr_date"]) == (990.0, D("2026-06-25"))
    assert (got["rear_delt_fly"]["weight_pr"], got["rear_delt_fly"]["weight_pr_date"]) == (7.0, D("2026-06-13"))
    assert (got["rear_delt_fly"]["tonnage_pr"], got["rear_delt_fly"]["tonnage_pr_date"]) == (252.0, D("2026-06-20"))


def test_date_session_merges_workouts_of_a_day(make):
    t = make([(1, 7, "2026-01-05", "A"), (2, 7, "2026-01-05", "B", "2026-01-05T20:00:00")],
             [(1, 1, 1, 50.0, 8), (2, 1, 1, 60.0, 5), (2, 1, 2, 60.0, 7), (2, 1, 3, 55.0, 9)], EX)
    assert rows(history.exercise_progress(t), "max_weight", "reps", "sets_count") == [(60.0, 7, 2)]
    # the day overview takes the newest workout only, its minima may stem from different sets
    assert rows(sessions.newest_workout_per_exercise(t), "workout_id", "weight_kg", "reps", "sets_count") == [(2, 55.0, 5, 3)]
    # the last log takes the first set of the newest workout
    assert rows(sessions.last_exercise_log(t), "weight_kg", "reps", "sets_count") == [(60.0, 5, 3)]
    assert rows(history.exercise_sessions(t), "session_count") == [(1,)]


def test_muscle_groups_leave_out_unknown(make):
    t = make([(1, 7, "2026-01-05", None)], [(1, 5, 1, 5.0, 5), (1, 1, 1, 5.0, 5)], EX)
    assert rows(history.muscle_group_sessions(t), "muscle_group") == [("chest",)]


def test_user_and_slug_filters(make):
    t = make([(1, 7, "2026-01-05", None), (2, 8, "2026-01-06", None)],
             [(1, 1, 1, 50.0, 8), (2, 1, 1, 60.0, 5), (2, 2, 1, 20.0, 5)], EX)
    assert rows(history.exercise_progress(t, users=[8]), "user_id", "slug") == [(8, "bench_press"), (8, "rope_pushdown")]
    assert rows(history.exercise_progress(t, users=8, slug="bench_press"), "max_weight") == [(60.0,)]
    one = t["workouts"].where("user_id = 7").select("user_id")
    assert rows(history.exercise_tonnage(t, users=one), "tonnage") == [(400.0,)]


def test_filters_reach_the_scan(t):
    plan = history.scan_log(t, start="1998-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in plan


def test_last_summary_focus_rules(make):
    t = make([(1, 7, "2026-01-05", "Chest"), (2, 7, "2026-01-06", " Back ", "2026-01-06T08:00:00"),
              (3, 7, "2026-01-06", "Logged", "2026-01-06T09:00:00"), (4, 7, "2026-01-06", "  ", "2026-01-06T09:30:00"),
              (5, 7, "2026-01-07", "Legs")],  # no sets: not the last trained date
             [(1, 1, 1, 50.0, 8), (2, 1, 1, 52.0, 8), (3, 1, 1, 54.0, 6), (3, 2, 1, 20.0, 9)], EX)
    got = rows(sessions.last_workout_summary(t), "workout_date", "split_focus", "slug", "weight_kg", "sets_count")
    assert got == [(D("2026-01-06"), "Back", "bench_press", 54.0, 1), (D("2026-01-06"), "Back", "rope_pushdown", 20.0, 1)]


def test_today_overview_without_plan_is_empty(make, spark):
    split = spark.createDataFrame(
        [(7, "Mon/Tue", "Chest + Biceps", 2, True), (7, "Mon/Tue", "Back + Triceps", 1, False)],
        "user_id bigint, day_label string, focus string, sort_order int, is_active boolean")
    t = make([(1, 7, "2026-01-05", None)], [(1, 1, 1, 50.0, 8), (1, 2, 1, 20.0, 8)], EX, training_split=split)
    monday = sessions.today_overview(t, "2026-01-05")
    # the inactive row still wins by sort order
    assert rows(monday, "focus", "slug", "is_logged_today") == [("Back + Triceps", "rope_pushdown", True)]
    assert rows(sessions.today_overview(t, "2026-01-12"), "is_logged_today") == [(False,)]
    assert sessions.today_overview(t, "2026-01-07").count() == 0


def test_overview_keeps_untrained_exercises(make, spark):
    profile = spark.createDataFrame([(7,), (8,)], "user_id bigint")
    t = make([(1, 7, "2026-01-05", None)], [(1, 1, 1, 50.0, 8)], EX, profile=profile)
    got = rows(sessions.muscle_session_overview(t, "2026-01-05", muscle="chest"), "user_id", "session_count", "is_logged_today")
    assert got == [(7, 1, True), (8, 0, False)]
    none = rows(sessions.no_history_exercises(t), "user_id", "slug")
    zero = rows(sessions.muscle_session_overview(t, "2026-01-05").where("session_count = 0"), "user_id", "slug")
    assert none == zero
    picked = rows(sessions.session_picker(t, "2026-01-05").where("section = 'top'"), "user_id", "slug")
    assert picked == [(7, "bench_press")]


def test_history_window_keeps_the_oldest(make):
    w = [(i, 7, str(D("2026-01-01") + dt.timedelta(days=i)), "Chest") for i in range(60)]
    t = make(w, [(59, 1, 1, 50.0, 8)], EX)
    kept = [r[0] for r in rows(history.history_window(t), "workout_id")]
    assert sorted(kept) == list(range(50))
    assert rows(history.focus_counts(t), "workouts", "chest_related") == [(50, 50)]
    # the capped last log looks at the newest 40 only
    t2 = make(w, [(5, 1, 1, 50.0, 8), (30, 2, 1, 10.0, 5)], EX)
    assert rows(sessions.last_exercise_log(t2, cap=40), "slug") == [("rope_pushdown",)]


def test_set_texts(make):
    t = make([(1, 7, "2026-01-05", None)],
             [(1, 1, 1, 66.0, 6), (1, 1, 2, 66.0, 6), (1, 2, 1, 32.5, 8), (1, 2, 2, 30.0, 10), (1, 2, 3, 32.5, 8)], EX)
    assert rows(reports.set_detail(t), "exercise_id", "detail") == [
        (1, "66.0 kg × 6 × 2"), (2, "30.0×10, 32.5×8, 32.5×8")]


def test_records_bound_every_point(t):
    joined = history.session_points(t).join(history.exercise_records(t), ["user_id", "slug"])
    assert joined.where("max_weight > weight_pr or tonnage > tonnage_pr").count() == 0


def test_no_profile_no_document(t):
    docs = reports.profile_snapshot(t)
    assert docs.count() == t["profile"].count()
    assert docs.where(F.col("document").contains("## Full workout log")).count() > 0


def test_progression_speaks_of_the_alias_catalog(make, spark):
    catalog_source = spark.createDataFrame(
        [("rope_pushdown", "The pushdown", "triceps", ["push"], 0), ("bench_press", "The bench", "chest", ["bench"], 1)],
        "slug string, canonical string, muscle_group string, aliases array<string>, ord int")
    t = make([(1, 7, "2026-01-05", "Chest")], [(1, 1, 1, 50.0, 8), (1, 2, 1, 20.0, 9), (1, 5, 1, 5.0, 5)], EX, catalog_source=catalog_source)
    got = rows(reports.key_lift_progression(t), "ord", "slug", "block")
    assert [r[:2] for r in got] == [(0, "rope_pushdown"), (1, "bench_press")]
    assert got[0][2].startswith("**The pushdown:**\n  - 2026-01-05 (Chest): 20.0 kg × 9 × 1")


def test_first_set_with_many_reps(make):
    t = make([(1, 7, "2026-01-05", None)], [(1, 1, 1, 20.0, 10_000), (1, 1, 1, 20.01, 0)], EX)
    assert rows(sessions.last_exercise_log(t), "weight_kg", "reps") == [(20.0, 10_000)]


def test_groups_outside_the_usual_six_stay(make, spark):
    exercises = [(1, "bench_press", "Bench", "chest", None), (2, "plank", "Plank", "core", "bodyweight"), (3, "odd", "Odd", None, None)]
    profile = spark.createDataFrame([(7,), (8,)], "user_id bigint")
    t = make([(1, 7, "2026-01-05", None)], [(1, 1, 1, 20.0, 5)], exercises, profile=profile)
    assert rows(sessions.no_history_exercises(t), "user_id", "slug") == [(7, "odd"), (7, "plank"), (8, "bench_press"), (8, "odd"), (8, "plank")]
    assert sessions.muscle_session_overview(t, "2026-01-05").count() == 6
    assert rows(sessions.muscle_session_overview(t, "2026-01-05", muscle="core"), "user_id", "slug") == [(7, "plank"), (8, "plank")]
