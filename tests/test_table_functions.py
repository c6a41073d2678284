"""SQL table functions against the DataFrame operators."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from liftlake.operators import history, sessions, writes
from liftlake.plans import table_functions
from liftlake.sources.tables import Tables

DAY = "1998-06-15"


@pytest.fixture
def call(t, spark):
    table_functions.register_functions(spark, t)
    return lambda text: spark.sql(f"SELECT * FROM {text}")


def busiest(t):
    return t["workouts"].where(f"workout_date = '{DAY}'").groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]


def test_one_user(t, call):
    u = busiest(t)
    of = lambda df, *cols: rows(df.where(F.col("user_id") == u), *cols)
    assert rows(call(f"exercise_progress({u}, 'ex_3')")) == of(
        history.exercise_progress(t, slug="ex_3"), "workout_date", "max_weight", "reps", "sets_count") != []
    assert rows(call(f"exercise_tonnage({u}, 'ex_3')")) == of(history.exercise_tonnage(t, slug="ex_3"), "workout_date", "tonnage", "sets_count")
    assert rows(call(f"last_exercise_log({u}, 'ex_3')")) == of(
        sessions.last_exercise_log(t, slug="ex_3"), "workout_date", "weight_kg", "reps", "sets_count")
    assert rows(call(f"user_muscle_groups({u})")) == of(history.muscle_group_sessions(t), "muscle_group", "session_count") != []
    assert rows(call(f"user_exercises_for_muscle({u}, 'core')")) == of(
        history.exercise_sessions(t, muscle="core"), "slug", "name", "session_count")
    assert rows(call(f"last_workout_summary({u})")) == of(
        sessions.last_workout_summary(t), "workout_date", "split_focus", "slug", "name", "muscle_group", "weight_kg", "reps", "sets_count") != []
    assert rows(call("exercise_progress(-5, 'ex_3')")) == rows(call(f"exercise_progress({u}, 'none')")) == []
    assert rows(call(f"bench_press_progress({u})")) == []


def test_overviews_of_a_day(t, call):
    users = [r["user_id"] for r in t["profile"].select("user_id").orderBy("user_id").limit(6).collect()] + [busiest(t)]
    cols = ["slug", "name", "muscle_group", "session_count", "is_logged_today", "last_weight_kg", "last_reps", "last_sets_count"]
    sess = sessions.muscle_session_overview(t, DAY, muscle="chest").cache()
    today = sessions.today_overview(t, DAY).cache()
    seen = 0
    for u in users:
        mine = rows(sess.where(F.col("user_id") == u), *cols)
        if mine:  # the operator covers registered users
            assert rows(call(f"muscle_session_overview({u}, 'chest', DATE '{DAY}')")) == mine
        plan = rows(today.where(F.col("user_id") == u), "focus", *[c for c in cols if c != "session_count"])
        assert rows(call(f"today_workout_overview({u}, DATE '{DAY}')")) == plan
        seen += len(plan)
    assert seen
    # The day may be left out.
    assert {r["is_logged_today"] for r in call(f"muscle_session_overview({users[0]}, 'chest')").collect()} == {False}


def test_functions_follow_the_rows_of_a_query(t, call, spark):
    t["profile"].createOrReplaceTempView("asked")
    got = spark.sql("SELECT a.user_id, p.* FROM asked a, LATERAL exercise_progress(a.user_id, 'ex_3') p")
    expected = history.exercise_progress(t, slug="ex_3").join(t["profile"].select("user_id"), "user_id", "left_semi").drop("slug")
    assert rows(got, *expected.columns) == rows(expected)


def test_user_filter_is_pushed(t, spark, tmp_path):
    flat = writes.write_log(t, str(tmp_path / "log")).tables(t)
    table_functions.register_functions(spark, flat)
    plan = spark.sql("SELECT * FROM exercise_progress(7, 'ex_3')")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(user_id,7\)", plan) and "EqualTo(slug,ex_3)" in plan
    table_functions.register_functions(spark, Tables(spark, t.path))


@pytest.fixture
def save(make, spark):
    t = make(workouts=[(10, 1, "2026-01-05", "Back", "2026-01-05T08:00:00"), (11, 1, "2026-01-05", "Legs", "2026-01-05T09:00:00"),
                       (12, 1, "2026-01-06", "In progress", "2026-01-06T08:00:00"), (13, 1, "2026-01-07", "Logged", "2026-01-07T08:00:00")]
             + [(20 + i, 2, "2026-01-05", "Chest" if i == 0 else "Legs", f"2026-01-05T1{i}:00:00") for i in range(6)],
             sets=[(10, 1, 1, 50.0, 5)],
             exercises=[(1, "row", "Row", "back", "barbell"), (2, "dip", "Dip", "chest", "bodyweight"), (3, "curl", "Curl", "biceps", "barbell")])
    table_functions.register_functions(spark, t)

    def call(user, slug, weight, reps, sets, day, now="2026-01-06 13:00:00"):
        r = spark.sql(f"SELECT * FROM log_exercise_session({user}, '{slug}', {weight}, {reps}, {sets}, DATE '{day}', TIMESTAMP_NTZ '{now}')").collect()
        assert len(r) == 1
        return tuple(r[0])

    return t, call


def test_what_a_save_would_do(save):
    _, call = save
    assert call(1, "row", 40, 5, 3, "2026-01-05") == ("10", True, "Back + Triceps", None)       # an older spelling fits
    assert call(1, "dip", 0, 5, 3, "2026-01-05") == ("1|2026-01-05|Chest + Biceps", False, "Chest + Biceps", None)
    assert call(1, "dip", 0, 5, 3, "2026-01-06") == ("12", False, "Chest + Biceps", None)       # continued within six hours
    assert call(1, "dip", 0, 5, 3, "2026-01-06", "2026-01-06 14:00:01")[0] == "1|2026-01-06|Chest + Biceps"
    assert call(1, "curl", 10, 5, 3, "2026-01-07")[0] == "13"                                     # 'Logged' takes everything
    assert call(2, "dip", 0, 5, 3, "2026-01-05")[0] == "2|2026-01-05|Chest + Biceps"              # the sixth newest is out of sight
    assert [call(1, *x, "2026-01-05")[3] for x in (("row", 40, 5, 0), ("row", 40, 0, 3), ("row", -1, 5, 3), ("none", 40, 5, 3), ("row", 0, 5, 3))] == [
        "bad_sets", "bad_reps", "bad_weight", "unknown_exercise", "zero_weight"]


def test_a_save_agrees_with_the_write_path(save, spark):
    from conftest import log_events

    t, call = save
    for slug, exercise, day, hour in (("row", 1, "2026-01-05", 12), ("dip", 2, "2026-01-06", 13), ("curl", 3, "2026-01-06", 23), ("dip", 2, "2026-01-07", 9)):
        event = log_events(spark, [(1, 1, f"{day}T{hour:02d}:00:00", exercise, 40, 5, 3)])
        receipt, _ = writes.log_sessions(t, event, existing=t["workouts"], existing_sets=t["workout_sets"], as_of="2026-01-06")
        r = receipt.first()
        assert call(1, slug, 40, 5, 3, day, f"2026-01-06 {hour:02d}:00:00")[:3] == (r["workout_key"], r["replaced"], r["split_focus"])
