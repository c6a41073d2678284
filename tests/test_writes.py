"""The write path against a sequential replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import log_events, rows
from liftlake.operators import history, writes
from liftlake.sources import catalog

MUSCLES = ["chest", "back", "legs", "biceps", "triceps", "shoulders", ""]
EX = [(i, f"ex{i}", f"Ex {i}", m or None, "bodyweight") for i, m in enumerate(MUSCLES)]
APP = {"chest": "Chest + Biceps", "back": "Back + Triceps", "legs": "Legs"}
CHAT = {m: m.capitalize() for m in MUSCLES if m}


def replay(events, existing, rule, as_of=None):
    """Workout key per event, one event after the other."""
    days, out = {}, {}
    for w in sorted(existing, key=lambda w: (w[4], w[0])):
        days.setdefault((w[1], w[2]), []).insert(0, (w[3], str(w[0]), w[4]))
    for e in sorted(events, key=lambda e: (e[2], e[0])):
        muscle, day = MUSCLES[e[3]], e[2][:10]
        focus = (APP if rule == "app" else CHAT).get(muscle, "Logged")
        seen = days.setdefault((e[1], day), [])
        fits = {focus, "Logged"}
        if rule == "app" and muscle in ("chest", "back"):
            fits |= {muscle.capitalize()}
        key = next((k for f, k, _ in seen[:5] if f in fits), None)
        if key is None and day == as_of and seen and seen[0][0] == "In progress":
            age = dt.datetime.fromisoformat(e[2]) - dt.datetime.fromisoformat(seen[0][2])
            if age <= dt.timedelta(hours=6):
                key = seen[0][1]
        if key is None:
            key = f"{e[1]}|{day}|{focus}"
            if any(k == key for _, k, _ in seen):
                key += f"|{e[0]}"
            seen.insert(0, (focus, key, e[2]))
        out[e[0]] = key
    return out


def random_log(seed, n_events, n_users=3, n_days=3, n_old=0):
    rng = random.Random(seed)
    day = lambda: f"2026-01-{rng.randint(5, 4 + n_days):02d}"
    time = lambda: f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}"
    events = [(i, rng.randint(1, n_users), f"{day()}T{time()}", rng.randrange(len(MUSCLES)), 10, 5, 3)
              for i in range(n_events)]
    foci = ["Chest", "Chest + Biceps", "Back", "Back + Triceps", "Legs", "Shoulders", "In progress", "Biceps", None]
    old = [(1000 + i, rng.randint(1, n_users), d, rng.choice(foci), f"{d}T{time()}")
           for i, d in ((i, day()) for i in range(n_old))]
    return events, old


@pytest.mark.parametrize("rule,n_old,fold_limit", [
    ("app", 0, 256), ("app", 40, 256), ("app", 40, 0), ("chat", 0, 0), ("chat", 0, 256), ("chat", 40, 5), ("chat", 40, 256)])
def test_attach_equals_replay(make, rule, n_old, fold_limit):
    events, old = random_log(11 + n_old, 150, n_old=n_old)
    t = make(workouts=old, exercises=EX, events=events)
    existing = t["workouts"] if n_old else None
    as_of = "2026-01-06" if n_old else None
    got = writes.attach_workouts(t, t["log_events"], rule, existing, as_of, fold_limit)
    assert dict(rows(got, "event_id", "workout_key")) == replay(events, old, rule, as_of)


def test_workouts_fall_out_of_sight(make):
    """Six foci in turn: with five candidates each one is created again and again under the chat rule."""
    events = [(i, 1, f"2026-01-05T10:00:{i:02d}", i % 6, 10, 5, 3) for i in range(8)]
    t = make(exercises=EX, events=events)
    for limit in (0, 256):
        got = dict(rows(writes.attach_workouts(t, t["log_events"], "chat", fold_limit=limit), "event_id", "workout_key"))
        assert got == replay(events, [], "chat")
        assert len(set(got.values())) == 8


def cycling_log(seed, n_events, unknown_from=None):
    """One day of one user (and another's small day) whose foci come back all the time."""
    rng = random.Random(seed)
    events = []
    for i in range(n_events):
        muscle = rng.randrange(6) if unknown_from is None or i < unknown_from else rng.choice([rng.randrange(6), 6])
        events.append((i, 1 if i % 17 else 2, f"2026-01-05T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", muscle, 10, 5, 3))
    return events


@pytest.mark.parametrize("seed,n_events,unknown_from,n_old", [(1, 900, None, 0), (2, 700, 400, 6), (3, 600, 3, 3), (4, 40, None, 0)])
def test_large_days_are_scanned(make, monkeypatch, seed, n_events, unknown_from, n_old):
    monkeypatch.setattr(writes, "BLOCK_BITS", 3)  # several blocks and groups of blocks
    events = cycling_log(seed, n_events, unknown_from)
    _, old = random_log(seed, 0, n_users=2, n_days=1, n_old=n_old)
    t = make(workouts=old, exercises=EX, events=events)
    got = writes.attach_workouts(t, t["log_events"], "chat", t["workouts"] if n_old else None, fold_limit=0)
    assert dict(rows(got, "event_id", "workout_key")) == replay(events, old, "chat")


def test_number_of_jobs_does_not_follow_the_creations(make, spark):
    def jobs(n_events):
        t = make(exercises=EX, events=cycling_log(9, n_events))
        t["exercises"].count()
        group = f"creations {n_events}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            got = dict(rows(writes.attach_workouts(t, t["log_events"], "chat", fold_limit=0), "event_id", "workout_key"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(set(got.values())) > n_events / 40
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(200), jobs(1500)
    assert many <= few + 5


def test_hot_day_needs_no_replay_under_the_app_rule(make):
    """One (user, day) with most rows is placed by aggregates alone."""
    events, _ = random_log(5, 2000, n_users=1, n_days=1)
    t = make(exercises=EX, events=events)
    df = writes.attach_workouts(t, t["log_events"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    assert dict(rows(df, "event_id", "workout_key")) == replay(events, [], "app")


def test_sets_are_replaced(make, spark):
    events = [(1, 1, "2026-01-05T10:00:00", 0, 50, 5, 3), (2, 1, "2026-01-05T11:00:00", 0, 55, 4, 2),
              (3, 1, "2026-01-05T12:00:00", 1, 40, 8, 1), (4, 1, "2026-01-06T10:00:00", 0, 60, 3, 1)]
    t = make(exercises=EX, events=events)
    attached = writes.attach_workouts(t, t["log_events"])
    sets = writes.replace_sets(t, attached)
    assert rows(sets, "exercise_id", "set_number", "weight_kg", "replaced") == [
        (0, 1, 55.0, True), (0, 1, 60.0, False), (0, 2, 55.0, True), (1, 1, 40.0, False)]
    assert dict(rows(writes.log_receipt(attached), "event_id", "replaced")) == {1: False, 2: True, 3: False, 4: False}
    assert set(rows(writes.log_receipt(attached, rule="chat"), "replaced")) == {(False,)}
    stored = writes.apply_sets(sets.drop("replaced"), sets)
    assert rows(stored, "workout_key", "set_number") == rows(sets, "workout_key", "set_number")


def test_stored_sets_count_as_replaced(make, spark):
    old = [(77, 1, "2026-01-05", "Chest", "2026-01-05T08:00:00")]
    t = make(workouts=old, sets=[(77, 0, 1, 20.0, 5)], exercises=EX,
             events=[(1, 1, "2026-01-05T10:00:00", 0, 50, 5, 1)])
    receipts, sets = writes.log_sessions(t, t["log_events"], existing=t["workouts"], existing_sets=t["workout_sets"])
    assert rows(receipts, "workout_key", "replaced") == [("77", True)]
    assert rows(sets, "workout_key", "weight_kg", "replaced") == [("77", 50.0, True)]


def test_profile_upsert(spark):
    schema = "user_id bigint, display_name string, weight_kg decimal(5,2), goal string, notes string, nutrition map<string,int>"
    old = spark.createDataFrame([(1, "A", None, "x", "n", {"k": 1}), (2, "B", None, "y", None, None)], schema)
    new = spark.createDataFrame([(1, "ignored", None, None, "m", {"k": 2}), (3, "C", None, "z", None, None)], schema)
    got = rows(writes.upsert_profile(old, new), "user_id", "display_name", "goal", "notes", "nutrition")
    assert got == [(1, "A", None, "m", {"k": 2}), (2, "B", "y", None, None), (3, "C", "z", None, None)]


def test_one_update_of_a_user_counts(spark):
    schema = "user_id bigint, display_name string, weight_kg decimal(5,2), goal string, notes string, nutrition map<string,int>, updated_at timestamp_ntz"
    at = lambda d: dt.datetime(2026, 1, d)
    old = spark.createDataFrame([(1, "A", None, "x", "n", {"k": 1}, at(1))], schema)
    new = [(1, "B", None, "late", None, {"k": 3, "a": 1}, at(9)), (1, "C", None, "early", None, {"k": 2}, at(5)), (1, "B", None, None, None, None, None),
           (4, "D", None, "one", None, None, at(2)), (4, "D", None, "two", None, None, at(2))]
    for order in (new, new[::-1]):
        got = rows(writes.upsert_profile(old, spark.createDataFrame(order, schema).repartition(3)), "user_id", "display_name", "goal", "nutrition", "updated_at")
        assert got == [(1, "A", "late", {"k": 3, "a": 1}, at(9)), (4, "D", "two", None, at(2))]


def test_repeated_new_rows_are_inserted_once(spark):
    stored = spark.createDataFrame([(1, "Mon/Tue", "Chest", 1)], "user_id bigint, day_label string, focus string, sort_order int")
    new = [(1, "Fri/Sat", "Back", 2), (1, "Fri/Sat", "Back", 5), (1, "Mon/Tue", "Chest", 7), (2, None, "Back", 1), (2, None, "Back", 1)]
    keys = ["user_id", "day_label", "focus"]
    for order in (new, new[::-1]):
        given = spark.createDataFrame(order, stored.schema).repartition(3)
        once = writes.insert_missing(stored, given, keys, newest=["sort_order"])
        assert rows(once) == sorted([(1, "Mon/Tue", "Chest", 1), (1, "Fri/Sat", "Back", 5), (2, None, "Back", 1)], key=repr)
        assert rows(writes.insert_missing(once, given, keys)) == rows(once)


def test_a_repeated_seed_row_is_chosen_by_order(spark):
    schema = "slug string, name string, muscle_group string"
    seed = [("a", "Zeta", None), ("a", "Alpha", "chest"), ("b", "Beta", None), ("c", "C", None)]
    for order in (seed, seed[::-1]):
        got = catalog.seed_missing(spark.createDataFrame([("c", "kept", None)], schema), spark.createDataFrame(order, schema).repartition(3))
        assert rows(got) == [("a", "Alpha", "chest"), ("b", "Beta", None), ("c", "kept", None)]
    numbered = spark.createDataFrame([("a", "Zeta", 1), ("a", "Alpha", 2)], "slug string, name string, ord int")
    assert rows(catalog.seed_missing(numbered.limit(0), numbered)) == [("a", "Zeta", 1)]


def test_plan_rows_are_not_doubled(spark):
    rows_ = spark.createDataFrame([(1, "Mon/Tue", "Chest", 1)], "user_id bigint, day_label string, focus string, sort_order int")
    new = spark.createDataFrame([(1, "Mon/Tue", "Chest", 9), (1, "Fri/Sat", "Back", 2)], rows_.schema)
    once = writes.insert_missing(rows_, new, ["user_id", "day_label", "focus"])
    again = writes.insert_missing(once, new, ["user_id", "day_label", "focus"])
    assert once.count() == 2 and rows(once) == rows(again)


def test_written_log_is_partitioned_and_complete(t, tmp_path):
    back = writes.write_log(t, str(tmp_path / "log")).read()
    assert back.count() == history.scan_log(t).count()
    plan = back.where("month = '1998-06'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_cascade_leaves_no_orphans(t):
    gone = t["profile"].limit(3).select("user_id")
    kept = writes.cascade_delete(t, gone)
    users = {r[0] for r in gone.collect()}
    for name in ("profile", "goals", "injuries", "exercise_bans", "training_split", "user_exercises", "workouts"):
        assert kept[name].where(F.col("user_id").isin(users)).count() == 0
    assert kept["workout_sets"].join(kept["workouts"], "workout_id", "left_anti").count() == 0
    refs = kept["user_exercises"].where("split_id is not null")
    assert refs.join(kept["training_split"], "split_id", "left_anti").count() == 0
