"""Streaming jobs over several arrivals."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from liftlake.operators import common, writes
from liftlake.sources.tables import SOURCE_SCHEMAS, Tables
from liftlake.streaming import live


class Arrivals(Tables):
    """Tables whose events arrive as several files, one micro-batch each."""

    def __init__(self, spark, base, folder):
        super().__init__(spark, base)
        self.folder = folder


@pytest.fixture
def arrive(spark, t, tmp_path, monkeypatch):
    """arrive([rows of batch 1, rows of batch 2, ...]) -> tables streaming them in order."""

    def build(batches):
        folder = str(tmp_path / "events")
        os.makedirs(folder, exist_ok=True)
        for i, batch in enumerate(batches):
            df = spark.createDataFrame(
                [(e, dt.datetime.fromisoformat(ts), u, "view", float(v), f'{{"k": {k}}}') for e, ts, u, v, k in batch],
                SOURCE_SCHEMAS["events"])
            df.coalesce(1).write.mode("append").parquet(folder)
            for name in os.listdir(folder):  # file times order the arrivals
                if name.endswith(".parquet") and not name.startswith("."):
                    path = os.path.join(folder, name)
                    if os.path.getmtime(path) > 2_000_000_000 - 1000:
                        continue
                    os.utime(path, (2_000_000_000 + i, 2_000_000_000 + i))
        tables = Tables(spark, t.path)
        tables["events"] = spark.read.schema(SOURCE_SCHEMAS["events"]).parquet(folder)

        def stream(_tables, name="events.parquet"):
            return (spark.readStream.schema(SOURCE_SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
                    .parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")))

        monkeypatch.setattr(live, "event_stream", stream)
        return tables

    return build


# k = exercise and reps (k % 40, k % 9); sets = event_id % 5
FIRST = [(1, "2026-01-05T10:00:00", 1, 50, 42), (2, "2026-01-05T11:00:00", 1, 60, 42), (3, "2026-01-05T12:00:00", 2, 30, 7)]
SECOND = [(4, "2026-01-05T13:00:00", 1, 70, 42), (6, "2026-01-09T10:00:00", 1, 20, 7)]
THIRD = [(7, "2026-01-05T14:00:00", 1, 99, 42), (8, "2026-01-09T11:00:00", 2, 40, 7)]  # 7 comes four days late


def test_late_rows_are_dropped(arrive):
    # Spark compares late rows with the watermark of the batch before, hence one batch in between.
    t = arrive([FIRST, SECOND, THIRD[1:], THIRD[:1]])
    live_rows = rows(live.stream_daily_tonnage(t).where("user_id = 1"), "workout_date", "logs")
    assert live_rows == [(dt.date(2026, 1, 5), 3), (dt.date(2026, 1, 9), 1)]


def test_last_log_is_the_newest_by_time(arrive):
    t = arrive([SECOND, FIRST])
    got = dict(rows(live.stream_last_log(t).where("user_id = 1"), "slug", "event_id"))
    assert got == {"ex_1": 4, "ex_7": 6}


def test_upsert_rebuilds_touched_days_once(arrive):
    redelivered = [*SECOND, FIRST[0]]
    t = arrive([FIRST, redelivered, THIRD])
    events = t["log_events"].dropDuplicates(["event_id"])
    batch = writes.replace_sets(t, writes.attach_workouts(t, events))
    assert rows(live.stream_upsert(t)) == rows(batch)


def test_redelivery_counts_once(arrive):
    t = arrive([FIRST, [FIRST[1], *SECOND]])
    got = [r[0] for r in rows(live.stream_dedup(t), "event_id")]
    assert got == [1, 2, 3, 4, 6]


def test_bouts_equal_session_windows(t):
    from liftlake.operators.messages import validate

    events = t["log_events"]
    valid = validate(t, events).where("reason is null")
    windows = valid.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours")).agg(
        F.count(F.lit(1)).alias("logs"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    expected = rows(windows.select("user_id", F.date_format("a", "yyyy-MM-dd HH:mm:ss"),
                                   F.date_format("b", "yyyy-MM-dd HH:mm:ss"), "logs"))
    assert rows(live.training_bouts(t, events), "user_id", "started", "ended", "logs") == expected


def test_a_source_without_files_gives_empty_results(arrive):
    for job in (live.stream_ingest, live.stream_daily_tonnage, live.stream_last_log, live.stream_upsert, live.stream_dedup,
                live.stream_training_bouts):
        assert job(arrive([])).count() == 0


def many_arrivals(n):
    """Batches of a few events, each over days that earlier batches touched as well."""
    return [[(10 * b + i, f"2026-01-{5 + (b + i) % 4:02d}T{10 + b % 10:02d}:{i:02d}:00", 1 + i % 2, 50 + b, 42 if i else 7) for i in range(3)]
            for b in range(n)]


def test_stores_stay_small_and_right_over_many_batches(arrive, spark, tmp_path):
    from liftlake.sources.store import BatchStore

    t = arrive(many_arrivals(20))
    events = t["log_events"]
    batch = writes.replace_sets(t, writes.attach_workouts(t, events))
    work = str(tmp_path / "upsert")
    assert rows(live.stream_upsert(t, work=work)) == rows(batch)
    for name, schema, keys in (("events", events.schema, ["event_id"]), ("sets", "user_id bigint", ["user_id"])):
        entries = BatchStore(spark, f"{work}/{name}", schema, keys).entries()
        assert sum(e["batches"] for e in entries) == 20 and len(entries) <= 7
        assert len(os.listdir(f"{work}/{name}/data")) <= 2 * len(entries) + 8
    work = str(tmp_path / "last")
    first = rows(live.stream_last_log(t, work=work))
    names = sorted(os.listdir(f"{work}/out/data"))
    # Nothing has arrived since: a second run with the same folder changes nothing.
    assert rows(live.stream_last_log(t, work=work)) == first and sorted(os.listdir(f"{work}/out/data")) == names


def test_a_batch_replayed_after_a_failure_counts_once(arrive, spark, tmp_path, monkeypatch):
    """The job dies between its two stores; the restarted one repeats the batch and gets the same sets."""
    t = arrive([FIRST, SECOND, THIRD])
    expected = rows(writes.replace_sets(t, writes.attach_workouts(t, t["log_events"])))
    work, calls = str(tmp_path / "upsert"), []
    plain = live.replace_sets

    def failing(*args):
        calls.append(1)
        if len(calls) == 3:  # the first call is for the schema, the second for batch 0
            raise RuntimeError("executor lost")
        return plain(*args)

    monkeypatch.setattr(live, "replace_sets", failing)
    with pytest.raises(Exception, match="executor lost"):
        live.stream_upsert(t, work=work)
    monkeypatch.setattr(live, "replace_sets", plain)
    assert rows(live.stream_upsert(t, work=work)) == expected


def bout(user, day, start, end, n):
    return user, f"2026-01-{day:02d} {start}:00:00", f"2026-01-{day:02d} {end}:00:00", n


def test_live_bouts_close_and_drop_late_logs(arrive):
    late = [(20, "2026-01-05T15:00:00", 1, 99, 42)]   # would have joined the first bout of user 1
    later = [(21, "2026-01-14T10:00:00", 1, 20, 7)]    # moves the watermark on; its own bout stays open
    t = arrive([FIRST, SECOND, THIRD[1:], later, late])
    got = rows(live.stream_training_bouts(t), "user_id", "started", "ended", "logs")
    assert got == sorted([bout(1, 5, 10, 13, 3), bout(2, 5, 12, 12, 1), bout(1, 9, 10, 10, 1), bout(2, 9, 11, 11, 1)], key=repr)
    closed = [r for r in rows(live.training_bouts(t, t["log_events"].where("event_id not in (20, 21)")), "user_id", "started", "ended", "logs")]
    assert got == closed


def test_open_bouts_close_in_a_later_run(arrive, tmp_path, spark):
    work = str(tmp_path / "bouts")
    t = arrive([FIRST, SECOND])
    # User 1 logs on the ninth as well, so the bouts of the fifth close; that of the ninth waits.
    assert rows(live.stream_training_bouts(t, work=work), "user_id", "logs") == [(1, 3), (2, 1)]
    t = arrive([[(21, "2026-01-14T10:00:00", 3, 20, 7)]])
    assert rows(live.stream_training_bouts(t, work=work), "user_id", "logs") == [(1, 1), (1, 3), (2, 1)]


def test_only_touched_days_are_read_again(spark):
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    few = spark.createDataFrame([(1, day(3)), (2, day(3)), (1, day(5))], "user_id bigint, workout_date date")
    assert "IN" in str(common.listed_days(few)).upper() and "2026-01-04" in str(common.listed_days(few))
    many = spark.createDataFrame([(1, day(n)) for n in range(common.MAX_LISTED_DAYS + 5)], "user_id bigint, workout_date date")
    kept = many.where(common.listed_days(many))
    assert kept.count() == common.MAX_LISTED_DAYS + 5
