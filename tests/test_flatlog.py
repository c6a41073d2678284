"""The stored flat log: queries without joins, replacement as a whole; stored log tables; partial sums after a save."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from liftlake.operators import common, history, partials, sessions, writes
from liftlake.sources.flatlog import FlatLog, flat_rows
from liftlake.sources.tables import LOG_SCHEMAS, conform, open_log, save_log

QUERIES = {"scan": history.scan_log, "progress": history.exercise_progress, "tonnage": history.exercise_tonnage,
           "last": sessions.last_exercise_log, "records": history.exercise_records, "groups": history.muscle_group_sessions,
           "join": history.full_join, "day": sessions.newest_workout_per_exercise, "trained": history.trained_exercises}
WITHOUT_JOIN = ("scan", "progress", "tonnage", "last", "records")


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    from conftest import SMALL
    from liftlake.sources.tables import Tables

    t = Tables(spark, SMALL)
    return t, writes.write_log(t, str(tmp_path_factory.mktemp("log") / "flat"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_on_the_stored_log(log, name):
    t, stored = log
    query, flat = QUERIES[name], stored.tables(t)
    assert rows(query(flat)) == rows(query(t))
    assert rows(query(flat, users=[3, 7])) == rows(query(t, users=[3, 7]))
    if name in WITHOUT_JOIN:
        assert "Join" not in plan(query(flat))


def test_one_exercise_of_the_stored_log(log):
    t, stored = log
    flat = stored.tables(t)
    for query in (history.exercise_progress, history.exercise_tonnage, sessions.last_exercise_log):
        found = query(flat, users=7, slug="ex_3")
        assert rows(found) == rows(query(t, users=7, slug="ex_3")) != []
        assert "EqualTo(user_id,7)" in plan(found) and "EqualTo(slug,ex_3)" in plan(found) and "Join" not in plan(found)


def test_months_are_pruned(log):
    t, stored = log
    found = history.scan_log(stored.tables(t), start="1996-01-10", end="1996-03-05")
    assert rows(found) == rows(history.scan_log(t, start="1996-01-10", end="1996-03-05")) != []
    assert "PartitionFilters: [isnotnull(month" in plan(found)
    few = stored.read(start="1996-01-10", end="1996-03-05")
    assert {f.split("month=")[1][:7] for f in few.inputFiles()} == {"1996-01", "1996-02", "1996-03"}


def test_rows_are_sorted_by_user_within_files(log):
    _, stored = log
    per_file = stored.read().select(F.input_file_name().alias("f"), "user_id", F.monotonically_increasing_id().alias("n"))
    for f in {r[0] for r in per_file.select("f").distinct().limit(5).collect()}:
        users = [r[0] for r in per_file.where(F.col("f") == f).orderBy("n").select("user_id").collect()]
        assert users == sorted(users)


@pytest.fixture
def small(make, spark, tmp_path):
    """A log of two users over two months, one month held by user 2 alone."""
    t = make(workouts=[(1, 1, "2026-01-05", "Chest"), (2, 2, "2026-01-06", "Back"), (3, 2, "2026-02-01", None)],
             sets=[(1, 1, 1, 50.0, 5), (2, 1, 1, 60.0, 5), (2, 2, 1, 10.0, 9), (3, 1, 1, 65.0, 4), (3, 9, 1, 1.0, 1)],
             exercises=[(1, "a", "A", "chest", "barbell"), (2, "b", "B", None, "bodyweight")])
    return t, writes.write_log(t, str(tmp_path / "flat"))


def new_rows(spark, user, day, weight):
    d = dt.date.fromisoformat(day)
    return spark.createDataFrame([(user, 70 + user, d, "Legs", dt.datetime(2026, 3, 1), 1, "a", 1, weight, 3, None)],
                                 "user_id bigint, workout_id bigint, workout_date date, split_focus string, created_at timestamp_ntz, "
                                 "exercise_id bigint, slug string, set_number int, weight_kg double, reps int, rpe int").withColumn(
        "weight_kg", F.col("weight_kg").cast("decimal(6,2)"))


def listing(stored):
    return sorted((r["user_id"], str(r["workout_date"]), r["slug"], float(r["weight_kg"])) for r in stored.read().collect() if r["slug"])


def test_replacing_users_twice_gives_the_same_log(small, spark):
    _, stored = small
    for _ in range(2):
        stored.replace_users(new_rows(spark, 2, "2026-03-02", 80.0))
        assert listing(stored) == [(1, "2026-01-05", "a", 50.0), (2, "2026-03-02", "a", 80.0)]
        assert set(stored.months()) == {"2026-01", "2026-03"}  # nobody is left in February


def test_months_of_others_are_not_written_again(small, spark):
    _, stored = small
    before = stored.months()
    stored.replace_users(new_rows(spark, 1, "2026-01-07", 55.0))
    assert stored.months()["2026-02"] == before["2026-02"] and stored.months()["2026-01"] != before["2026-01"]
    assert listing(stored)[0] == (1, "2026-01-07", "a", 55.0)


def test_a_user_may_be_replaced_by_nothing(small, spark):
    _, stored = small
    stored.replace_users(new_rows(spark, 2, "2026-03-02", 80.0).limit(0), spark.createDataFrame([(2,)], "user_id bigint"))
    assert listing(stored) == [(1, "2026-01-05", "a", 50.0)]
    stored.replace_users(new_rows(spark, 1, "2026-03-02", 80.0).limit(0), spark.createDataFrame([(1,), (5,)], "user_id bigint"))
    assert stored.read().count() == 0 and stored.months() == {}


def test_a_failed_replacement_leaves_the_old_log(small, spark):
    _, stored = small
    before, months = listing(stored), stored.months()
    bad = new_rows(spark, 2, "2026-03-02", 80.0).withColumn("reps", F.when(F.col("user_id") == 2, F.raise_error(F.lit("lost"))).cast("int"))
    with pytest.raises(Exception, match="lost"):
        stored.replace_users(bad)
    assert listing(stored) == before and stored.months() == months
    stored.replace_users(new_rows(spark, 2, "2026-03-02", 80.0))
    assert listing(stored) == [(1, "2026-01-05", "a", 50.0), (2, "2026-03-02", "a", 80.0)]


def test_an_empty_log(spark, tmp_path, make):
    stored = FlatLog(spark, str(tmp_path / "none"))
    assert stored.read().count() == 0
    t = make()
    stored.write(flat_rows(t))
    assert stored.read().count() == 0 and rows(history.exercise_progress(stored.tables(t))) == []


# -- a user filter on the test views ---------------------------------------------


@pytest.mark.parametrize("users", [0, 7, [3, 9, 100000], [-1, 0]])
def test_user_filter_reaches_the_scan(t, users):
    found = history.scan_log(t, users=users)
    assert re.search(r"PushedFilters: \[[^]]*o_custkey", plan(found))
    assert rows(found) == rows(history.scan_log(t).where(F.col("user_id").isin([users] if isinstance(users, int) else users)))


# -- stored tables with declared schemas -----------------------------------------


def test_log_tables_round_trip(t, spark, tmp_path):
    save_log(t, str(tmp_path / "log"))
    back = open_log(spark, str(tmp_path / "log"))
    for name, schema in LOG_SCHEMAS.items():
        assert back[name].columns == spark.createDataFrame([], schema).columns
        assert back[name].count() == t[name].count()
    from liftlake.operators import reports

    for query in (history.exercise_progress, reports.active_bans, reports.current_injuries, reports.active_goals, reports.full_log,
                  reports.alias_reference, sessions.last_workout_summary):
        assert rows(query(back)) == rows(query(t))
    assert rows(reports.profile_snapshot(back), "user_id", "logged_workouts", "n_lifts") == rows(
        reports.profile_snapshot(t), "user_id", "logged_workouts", "n_lifts")


def test_declared_columns_are_demanded(spark):
    given = spark.createDataFrame([(1, "x")], "user_id bigint, body_part string")
    with pytest.raises(ValueError, match="injury_id"):
        conform(given, "injuries")
    full = conform(given.selectExpr("*", "7L as injury_id", "1 as extra"), "injuries")
    assert full.first().asDict() == {"injury_id": 7, "user_id": 1, "body_part": "x", "injury_type": "injury", "description": None,
                                     "status": "active", "started_on": None, "resolved_on": None, "notes": None}


# -- partial sums ----------------------------------------------------------------


def test_partial_sums_after_saves(make, spark, tmp_path):
    def at(sets, workouts=((1, 1, "2026-01-05", "x"), (2, 1, "2026-02-06", "x"), (3, 2, "2026-01-05", "x"))):
        return make(workouts=workouts, sets=sets, exercises=[(1, "a", "A", "chest", "barbell"), (2, "b", "B", "back", "barbell")])

    def touched(*days):
        return spark.createDataFrame([(u, dt.date.fromisoformat(d)) for u, d in days], "user_id bigint, workout_date date")

    kept = partials.SessionPartials(spark, str(tmp_path / "p"), fan=2)
    sets = [(1, 1, 1, 50.0, 5), (1, 2, 1, 20.0, 8), (2, 1, 1, 60.0, 3), (3, 1, 1, 70.0, 2)]
    assert kept.save(0, at(sets))
    assert rows(kept.points(at(sets))) == rows(history.session_points(at(sets)))
    # Workout 1 loses exercise 2, gets another set of 1; workout 3 changes but is not named yet.
    sets = [(1, 1, 1, 50.0, 5), (1, 1, 2, 50.0, 6), (2, 1, 1, 60.0, 3), (3, 1, 1, 75.0, 2)]
    old = rows(kept.points(at(sets)), "user_id", "slug", "max_weight")
    assert kept.save(1, at(sets), touched((1, "2026-01-05"), (1, "2026-01-05"), (9, "2026-05-05")))
    assert not kept.save(1, at([]), touched((1, "2026-01-05")))  # a replay
    now = rows(kept.points(at(sets)), "user_id", "slug", "max_weight")
    assert (1, "b", 20.0) in old and (1, "b", 20.0) not in now and (2, "a", 70.0) in now
    assert kept.save(2, at(sets), touched((2, "2026-01-05")))
    assert rows(kept.points(at(sets))) == rows(history.session_points(at(sets)))
    gone = [s for s in sets if s[0] != 2]
    assert kept.save(3, at(gone), touched((1, "2026-02-06")))
    assert rows(kept.points(at(gone))) == rows(history.session_points(at(gone)))


def test_only_touched_days_are_read(log, spark):
    t, stored = log
    days = t["workouts"].where("workout_date = '1996-02-03'").select("user_id", "workout_date").distinct()
    found = common.on_days(stored.read(), days)
    assert re.search(r"PartitionFilters: \[[^]]*month[^]]*1996-02", plan(found))
    assert rows(found, "user_id", "workout_id", "set_number") == rows(
        history.scan_log(t, start="1996-02-03", end="1996-02-03"), "user_id", "workout_id", "set_number")
