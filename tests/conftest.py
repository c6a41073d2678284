import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from liftlake.session import build_session  # noqa: E402
from liftlake.sources.tables import Tables  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, **{"spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def t(spark):
    return Tables(spark, SMALL)


@pytest.fixture
def make(spark):
    """Tables from literal rows: make(workouts=[...], sets=[...], exercises=[...])."""

    def build(workouts=(), sets=(), exercises=(), events=None, **frames):
        wrows = [(w[0], w[1], dt.date.fromisoformat(w[2]), w[3],
                  dt.datetime.fromisoformat(w[4] if len(w) > 4 else w[2] + "T10:00:00")) for w in workouts]
        out = {
            "workouts": spark.createDataFrame(
                wrows, "workout_id bigint, user_id bigint, workout_date date, split_focus string, created_at timestamp_ntz"),
            "workout_sets": spark.createDataFrame(
                list(sets), "workout_id bigint, exercise_id bigint, set_number int, weight double, reps int",
            ).selectExpr("workout_id", "exercise_id", "set_number", "cast(weight as decimal(6,2)) as weight_kg", "reps",
                         "cast(null as int) as rpe"),
            "exercises": spark.createDataFrame(
                [(e[0], e[1], e[2], e[3], e[4], i) for i, e in enumerate(exercises)],
                "exercise_id bigint, slug string, name string, muscle_group string, equipment string, ord int"),
        }
        if events is not None:
            out["log_events"] = log_events(spark, events)
        out.update(frames)
        return Tables(spark, SMALL).replaced(**out)

    return build


def log_events(spark, rows):
    """Events (event_id, user_id, ts, exercise_id, weight, reps, sets)."""
    full = [(r[0], r[1], dt.datetime.fromisoformat(r[2]), r[3], float(r[4]), r[5], r[6]) for r in rows]
    return spark.createDataFrame(
        full, "event_id bigint, user_id bigint, ts timestamp_ntz, exercise_id bigint, w double, reps int, sets_count int",
    ).selectExpr("event_id", "user_id", "ts", "cast(ts as date) as workout_date", "exercise_id",
                 "cast(w as decimal(6,2)) as weight_kg", "reps", "sets_count")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
