"""Live versions of the log: ingest, running aggregates, upsert and deduplication.

Each job runs over the files available now and stops; a service leaves the
trigger at a processing time instead. Results go to the shared folder. Update
mode results go to a batch store: a replayed batch changes nothing, and the
folders of single batches are merged as they add up.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from liftlake.operators.common import listed_days
from liftlake.operators.messages import validate
from liftlake.operators.writes import attach_workouts, replace_sets
from liftlake.session import shared_dir
from liftlake.sources.store import BatchStore
from liftlake.sources.tables import SOURCE_SCHEMAS

LATENESS = "2 days"
BOUT_GAP_HOURS = 6


def event_stream(t, name: str = "events.parquet") -> DataFrame:
    """Raw events as a file stream; watermarks need instants, so times become UTC instants.

    Tables with a folder of arrivals (``arriving``) stream its files, so many a batch.
    """
    folder, files = getattr(t, "arrivals", (None, None))
    reader = t.spark.readStream.schema(SOURCE_SCHEMAS["events"])
    if folder is None:
        reader, folder = reader.option("pathGlobFilter", name), t.path
    else:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def arriving(t, folder: str, files: int = 1):
    """Tables whose events arrive as the files of a folder, ``files`` a micro-batch."""
    out = t.replaced()
    out.arrivals = folder, files
    return out


def stream_tables(t, name: str = "events.parquet"):
    """Tables whose event view is the stream; the catalog stays static."""
    return t.replaced(events=event_stream(t, name), exercises=t["exercises"])


def _finish(writer, spark: SparkSession, work: str) -> None:
    query = writer.option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def _append(df: DataFrame, spark: SparkSession, work: str) -> DataFrame:
    out = f"{work}/out"
    _finish(df.writeStream.outputMode("append").format("parquet").option("path", out), spark, work)
    try:
        return spark.read.schema(df.schema).parquet(out)
    except AnalysisException as e:  # no batch ran
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], df.schema)


def _latest(df: DataFrame, spark: SparkSession, work: str, keys: list[str]) -> DataFrame:
    """Run in update mode and return the newest row per key; batches are merged as they add up."""
    store = BatchStore(spark, f"{work}/out", df.schema, keys, unique=True)
    _finish(df.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: store.commit(batch_id, batch)), spark, work)
    return store.read()


def stream_ingest(t) -> DataFrame:
    """Validate events as they arrive: accepted flag and reason per event."""
    live = stream_tables(t)
    checked = validate(live, live["log_events"]).select(
        "event_id", F.col("reason").isNull().alias("accepted"), "reason")
    return _append(checked, t.spark, shared_dir(t.spark, "ingest"))


def stream_daily_tonnage(t, lateness: str = LATENESS, work: str | None = None) -> DataFrame:
    """Tonnage per (user, exercise, day), kept up to date; rows later than ``lateness`` are dropped.

    Run again with the same ``work`` folder, a job goes on where it stopped.
    """
    live = stream_tables(t)
    valid = validate(live, live["log_events"]).where("reason is null")
    daily = (
        valid.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("day"), "user_id", "slug")
        .agg(F.sum(F.col("weight_kg") * F.col("reps") * F.col("sets_count")).alias("tonnage"),
             F.count(F.lit(1)).alias("logs"))
        .select(F.col("day.start").cast("date").alias("workout_date"), "user_id", "slug",
                F.col("tonnage").cast("double").alias("tonnage"), "logs")
    )
    return _latest(daily, t.spark, work or shared_dir(t.spark, "tonnage"), ["workout_date", "user_id", "slug"])


def stream_last_log(t, work: str | None = None) -> DataFrame:
    """Newest valid log per (user, exercise), kept up to date."""
    live = stream_tables(t)
    valid = validate(live, live["log_events"]).where("reason is null")
    last = valid.groupBy("user_id", "slug").agg(
        F.max_by(F.struct("event_id", "workout_date", "weight_kg", "reps", "sets_count"),
                 F.struct("ts", "event_id")).alias("last"))
    flat = last.select("user_id", "slug", "last.event_id", "last.workout_date",
                       F.col("last.weight_kg").cast("double").alias("weight_kg"), "last.reps", "last.sets_count")
    return _latest(flat, t.spark, work or shared_dir(t.spark, "last"), ["user_id", "slug"])


def stream_upsert(t, rule: str = "app", work: str | None = None) -> DataFrame:
    """Keep the sets current: every touched (user, date) is rebuilt from the stored events.

    A batch first stores its events, then rebuilds its days from all stored ones.
    Both stores count a batch once, so a replay is harmless whichever of them it
    finds done, and an event delivered again is stored once.
    """
    spark, work = t.spark, work or shared_dir(t.spark, "upsert")
    live = stream_tables(t)
    day = ["user_id", "workout_date"]
    arriving = live["log_events"]
    events = BatchStore(spark, f"{work}/events", arriving.schema, ["event_id"], unique=True, partition_by=["workout_date"])
    set_columns = replace_sets(t, attach_workouts(t, spark.createDataFrame([], arriving.schema), rule)).schema
    sets = BatchStore(spark, f"{work}/sets", StructType([arriving.schema[c] for c in day] + set_columns.fields), day)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read for its events, its dates and its days; rebuilt from the source where lost
        try:
            events.commit(batch_id, batch.dropDuplicates(["event_id"]))
            touched = batch.select(*day).distinct()
            stored = events.read(listed_days(touched)).join(touched, day, "left_semi")
            attached = attach_workouts(t, stored, rule)
            owners = attached.select("workout_key", *day).distinct()
            sets.commit(batch_id, replace_sets(t, attached).join(owners, "workout_key"))
        finally:
            batch.unpersist()

    _finish(arriving.writeStream.outputMode("append").foreachBatch(upsert), spark, work)
    return sets.read().drop(*day)


def stream_dedup(t, lateness: str = LATENESS) -> DataFrame:
    """Events delivered twice are counted once."""
    delivered = event_stream(t).union(event_stream(t))
    once = delivered.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"]).select(
        "event_id", "user_id", F.col("ts").cast("date").alias("day"))
    return _append(once, t.spark, shared_dir(t.spark, "dedup"))


def training_bouts(t, events: DataFrame, gap_hours: int = BOUT_GAP_HOURS) -> DataFrame:
    """Bouts of valid logs split where nothing happens for ``gap_hours``.

    Logs within one clock bucket of gap width always share a bout, so they are
    reduced per (user, bucket) first; a user then has a few rows per day.
    """
    gap = gap_hours * 3600
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    buckets = (
        validate(t, events).where("reason is null")
        .groupBy("user_id", F.floor(seconds / gap).alias("bucket"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("logs"),
             F.sum(F.col("weight_kg") * F.col("reps") * F.col("sets_count")).alias("tonnage"))
    )
    in_time = Window.partitionBy("user_id").orderBy("bucket")
    opens = F.coalesce(
        F.col("first_ts") >= F.lag("last_ts").over(in_time) + F.expr(f"interval {gap_hours} hours"), F.lit(True))
    numbered = buckets.withColumn("opens", opens.cast("int")).withColumn("bout", F.sum("opens").over(in_time))
    return numbered.groupBy("user_id", "bout").agg(
        F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("end_ts"),
        F.sum("logs").alias("logs"), F.sum("tonnage").cast("double").alias("tonnage"),
    ).select("user_id", "bout", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("started"),
             F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss").alias("ended"), "logs", "tonnage")


def stream_training_bouts(t, gap_hours: int = BOUT_GAP_HOURS, lateness: str = LATENESS, work: str | None = None) -> DataFrame:
    """Bouts as they close: session windows of valid logs, given out when ``lateness`` has passed since their gap.

    The state holds a user's open bouts only; a closed one leaves it, and a log that
    comes later than the watermark is dropped. A bout that is still open when the
    job stops is given out by a later run with the same ``work`` folder.
    """
    live = stream_tables(t)
    valid = validate(live, live["log_events"]).where("reason is null")
    bouts = (
        valid.withWatermark("ts", lateness)
        .groupBy("user_id", F.session_window("ts", f"{gap_hours} hours").alias("bout"))
        .agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("logs"),
             F.sum(F.col("weight_kg") * F.col("reps") * F.col("sets_count")).cast("double").alias("tonnage"))
        .select("user_id", F.date_format("bout.start", "yyyy-MM-dd HH:mm:ss").alias("started"),
                F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("ended"), "logs", "tonnage")
    )
    return _append(bouts, t.spark, work or shared_dir(t.spark, "bouts"))
