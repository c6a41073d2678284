"""Registered queries: name -> function of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.functions import rules
from liftlake.operators import history, messages, partials, quality, reports, sessions, writes
from liftlake.session import shared_dir
from liftlake.plans import table_functions
from liftlake.sources import catalog
from liftlake.sources.tables import CATALOG_SIZE, Tables, spoken_alias
from liftlake.streaming import live

AS_OF = "1998-06-15"       # fixed day of the day overviews
LIVE_DAY = "2024-01-10"    # 'today' of the continue rule
BOUND_SLUG = "ex_7"        # exercise of the pinned progress query

# Literal rows of the inline source and of the baseline workout.
LITERAL_SETS = [
    ("ex_0", 1, 20.0, 6), ("ex_0", 2, 20.0, 6), ("ex_0", 3, 22.5, 5),
    ("ex_5", 1, 12.5, 8), ("ex_5", 2, 12.5, 8),
    ("ex_17", 1, 5.0, 7), ("ex_39", 1, 27.5, 3), ("no_such_exercise", 1, 10.0, 10),
]
PLAN_ROWS = [
    ("Mon/Tue", "Chest + Biceps", 1),
    ("Wed/Thu", "Back + Triceps", 2),
    ("Fri/Sat", "Shoulders (+ legs sometimes)", 3),
]
REFRESHED_FROM = "1997-09-01"  # workouts from here on come to the partial sums later
TIME_ZONES = ["UTC", "Europe/Moscow", "America/New_York"]


# --- inputs derived from the tables -----------------------------------------

def form_entries(t) -> DataFrame:
    """Form input as typed: numbers with a comma, blanks, signs and words among them."""
    q = F.col("l_quantity")
    number = rules.plain_number(q.cast("decimal(18,2)") / 2)
    kind = F.col("l_suppkey") % 8
    weight = (
        F.when(kind == 0, F.replace(number, F.lit("."), F.lit(",")))
        .when(kind == 1, F.concat(F.lit("  "), number, F.lit(" ")))
        .when(kind == 2, "").when(kind == 3, F.concat(F.lit("-"), number))
        .when(kind == 4, F.concat(number, F.lit(",5,1"))).when(kind == 5, F.concat(number, F.lit(" kg")))
        .when(kind == 6, "0").otherwise(number)
    )
    return t["lineitem"].select(
        F.col("l_orderkey").alias("workout_id"), (F.col("l_partkey") % CATALOG_SIZE).alias("exercise_id"),
        F.col("l_linenumber").alias("set_number"), weight.alias("weight_text"),
        F.when(F.col("l_discount") > 0.08, "").otherwise(F.col("l_linenumber").cast("string")).alias("reps_text"),
        F.when(F.col("l_tax") > 0.07, "x3").otherwise(rules.plain_number(F.round(F.col("l_tax") * 50, 1))).alias("sets_text"),
    )


def _entries_with_kind(t) -> DataFrame:
    e = t["exercises"].select("exercise_id", rules.is_bodyweight(F.col("equipment")).alias("bodyweight"))
    return form_entries(t).join(e, "exercise_id")


def payloads(t) -> DataFrame:
    """Button payloads from the event log; some lack a part or carry no number."""
    e = t["log_events"]
    k = F.col("event_id") % 11
    slug = F.concat(F.lit("ex_"), (F.col("exercise_id") + F.when(k == 5, 40).otherwise(0)).cast("string"))
    weight = rules.plain_number(F.col("weight_kg"))
    parts = F.concat_ws(":", F.when(k == 3, "log:e").otherwise("log:s"), slug, weight, F.col("reps").cast("string"))
    return e.select(
        F.col("event_id").alias("entry_id"), "user_id", "workout_date",
        F.when(k == 7, parts).when(k == 9, F.concat(parts, F.lit(":many")))
        .otherwise(F.concat_ws(":", parts, F.col("sets_count").cast("string"))).alias("payload"))


def seed_rows(t) -> DataFrame:
    """Catalog seed from the parts: known slugs and twenty new ones."""
    first = F.min_by(F.struct("p_name", "p_type"), "p_partkey")
    g = t["part"].groupBy((F.col("p_partkey") % 60).alias("n")).agg(first.alias("p"))
    return g.select(
        F.concat(F.lit("ex_"), F.col("n").cast("string")).alias("slug"),
        F.upper("p.p_name").alias("name"), F.lower("p.p_type").alias("muscle_group"))


def _profile_updates(t) -> DataFrame:
    p = t["local_profiles"]
    return p.select("user_id", F.concat(F.lit("new "), F.col("display_name")).alias("display_name"),
                    (F.col("height_cm") + 1).alias("height_cm"),
                    (F.col("weight_kg") + 1).cast("decimal(5,2)").alias("weight_kg"),
                    F.upper("body_type").alias("body_type"), F.lower("goal").alias("goal"), "notes", "nutrition")


# --- queries ----------------------------------------------------------------

def nutrition_map(t):
    parsed = F.from_json("props", "map<string,int>")
    return t["events"].select("event_id", rules.json_text(parsed).alias("props_json"),
                              F.element_at(parsed, F.lit("k")).alias("k"))


def split_focus(rule):
    def query(t):
        e = t["exercises"].select("exercise_id", "muscle_group")
        return t["log_events"].join(e, "exercise_id", "left").select(
            "event_id", "muscle_group", rules.split_focus(F.col("muscle_group"), rule).alias("focus"))
    return query


def focus_to_muscles(t):
    return t["training_split"].select(
        "split_id", "focus", F.array_join(rules.plan_muscles(F.col("focus")), ",").alias("muscles"))


def set_labels(t):
    e = t["exercises"].select("exercise_id", rules.is_bodyweight(F.col("equipment")).alias("b"))
    args = [F.col("b"), F.col("weight_kg"), F.col("reps"), F.col("set_number")]
    return t["workout_sets"].join(e, "exercise_id").select(
        "workout_id", "exercise_id", "set_number",
        rules.set_label(*args).alias("label"), rules.session_point_label(*args).alias("point_label"))


def muscle_order(t):
    groups = t["exercises"].select("muscle_group").unionByName(
        t["part"].select(F.lower("p_type").alias("muscle_group")))
    return catalog.muscle_order(groups)


def parse_decimal(t):
    text = F.col("weight_text")
    return form_entries(t).select(
        "workout_id", "exercise_id", "set_number", "weight_text",
        rules.parse_decimal(text).alias("parsed"),
        rules.parse_log_weight(text, F.lit(False)).alias("loaded_weight"),
        rules.parse_log_weight(text, F.lit(True)).alias("bodyweight_load"))


def entry_preview(t):
    return _entries_with_kind(t).select(
        "workout_id", "exercise_id", "set_number", "weight_text",
        rules.entry_preview(F.col("weight_text"), F.col("reps_text"), F.col("sets_text"),
                            F.col("bodyweight")).alias("preview"))


def allowed_users(t):
    config = t["goals"].where("status = 'achieved' and horizon = 'long'").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(", ,"),
                 (F.col("user_id") + 2).cast("string"), F.lit(",")).alias("ids"))
    return reports.allowed_users(t["workouts"], config).select("workout_id", "user_id", "workout_date")


def profile_or_fallback(t):
    users = t["events"].select("user_id").unionByName(t["workouts"].select("user_id"))
    return reports.profile_or_fallback(users, t["profile"], t["local_profiles"])


def local_date(t):
    zones = rules.string_array(TIME_ZONES)
    tz = F.element_at(zones, (F.col("user_id") % len(TIME_ZONES) + 1).cast("int"))
    return t["events"].select("event_id", rules.local_date(F.col("ts"), tz).alias("local_date"))


def catalog_drift(t):
    return quality.catalog_drift(
        t["catalog_source"], seed_rows(t).unionByName(t["exercises"].where("ord >= 20").select(
            F.concat(F.lit("old_"), F.col("slug")).alias("slug"), "name", "muscle_group")))


def seed_missing(t):
    base = t["exercises"].select("slug", "name", "muscle_group")
    return catalog.seed_missing(base, seed_rows(t))


def seed_catalog(t):
    """Seeding twice gives the same catalog as seeding once."""
    once = seed_missing(t)
    return catalog.seed_missing(once, seed_rows(t))


def seed_plain(t):
    rows = F.array(*[F.struct(F.lit(d).alias("day_label"), F.lit(f).alias("focus"), F.lit(n).alias("sort_order"))
                     for d, f, n in PLAN_ROWS])
    new = t["profile"].select("user_id", F.inline(rows))
    stored = t["training_split"].select("user_id", "day_label", "focus", "sort_order")
    return writes.insert_missing(stored, new, ["user_id", "day_label", "focus"])


def defaults_applied(t):
    gaps = t["goals"].select(
        "user_id", "description", F.nullif("status", F.lit("paused")).alias("status"),
        F.when(F.col("sort_order") > 2, F.col("sort_order")).alias("sort_order"),
        F.when(F.col("horizon") == "long", True).alias("is_active"),
        F.when(F.col("horizon") == "short", "accessory").alias("role"),
        F.lit(None).cast("date").alias("workout_date"))
    return quality.with_defaults(gaps, AS_OF)


def replace_history(t):
    stored = t["workouts"].select("workout_id", "user_id", "workout_date", "split_focus")
    users = t["profile"].where("goal = 'BUILDING'").select("user_id")
    given = t["dated_workouts"].join(users, "user_id", "left_semi")
    return writes.replace_history(stored, given)


def cascade_delete(t):
    gone = t["all_profiles"].join(t["profile"].select("user_id"), "user_id", "left_anti")
    kept = writes.cascade_delete(t, gone)
    parts = [df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("table_name"), "kept")
             for name, df in kept.items()]
    nulled = kept["user_exercises"].agg(F.count_if(F.col("split_id").isNull()).alias("kept"))
    parts.append(nulled.select(F.lit("user_exercises.split_id is null").alias("table_name"), "kept"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert_profile(t):
    base = t["profile"].select("user_id", "display_name", "height_cm", "weight_kg", "body_type", "goal", "notes",
                               "nutrition")
    return writes.upsert_profile(base, _profile_updates(t)).select(
        "user_id", "display_name", "height_cm", F.col("weight_kg").cast("double").alias("weight_kg"),
        "body_type", "goal", "notes", rules.json_text(F.col("nutrition")).alias("nutrition"))


def attach(rule="app", existing=False, as_of=None):
    def query(t):
        old = t["dated_workouts"] if existing else None
        return writes.attach_workouts(t, t["log_events"], rule, old, as_of).select(
            "event_id", "user_id", "workout_date", "event_focus", "workout_key")
    return query


def replace_sets(t):
    return writes.replace_sets(t, writes.attach_workouts(t, t["log_events"]))


def log_receipt(t):
    return writes.log_receipt(writes.attach_workouts(t, t["log_events"]))


def _stored_log(t):
    return writes.write_log(t, shared_dir(t.spark, "log"))


def write_log(t):
    return _stored_log(t).read().select(
        "user_id", "workout_id", "workout_date", F.date_format("workout_date", "yyyy-MM").alias("month"),
        "exercise_id", "set_number", F.col("weight_kg").cast("double").alias("weight_kg"), "reps")


def on_stored_log(query):
    """A query over the flat log as it is stored, without joining sets to workouts."""
    return lambda t: query(_stored_log(t).tables(t))


def replace_stored_history(t):
    """Sets of the stored log after some users' history was replaced by sets of their event log."""
    log = _stored_log(t)
    users = t["profile"].where("goal = 'BUILDING'").select("user_id")
    attached = writes.attach_workouts(t, t["log_events"].join(users, "user_id", "left_semi"))
    owners = attached.groupBy("workout_key", "user_id", "workout_date").agg(
        F.min("ts").alias("created_at"), F.min_by("event_focus", F.struct("ts", "event_id")).alias("split_focus"))
    rows = writes.replace_sets(t, attached).join(owners, "workout_key")
    flat = rows.join(t["exercises"].select("exercise_id", "slug"), "exercise_id").select(
        "user_id", F.xxhash64("workout_key").alias("workout_id"), "workout_date", "split_focus", "created_at", "exercise_id", "slug",
        "set_number", F.col("weight_kg").cast("decimal(6,2)").alias("weight_kg"), "reps", F.lit(None).cast("int").alias("rpe"))
    log.replace_users(flat, users)
    return log.read().select("user_id", "workout_date", "month", "slug", "set_number", F.col("weight_kg").cast("double").alias("weight_kg"), "reps")


def in_batches(job, n: int = 4):
    """A streaming job over events that arrive as several files, one a micro-batch, some days in more than one of them."""
    def query(t):
        folder = shared_dir(t.spark, "arrivals")
        t["events"].repartitionByRange(n, "event_id").write.parquet(folder)
        return job(live.arriving(t, folder))
    return query


def called_functions(t):
    """Progress, tonnage and last log of one exercise for every registered user, asked for by SQL table functions."""
    table_functions.register_functions(t.spark, t)
    t["profile"].createOrReplaceTempView("asked_users")
    return t.spark.sql(f"""
        SELECT a.user_id, p.workout_date, p.max_weight, p.reps, n.tonnage, l.workout_date AS last_date, l.weight_kg AS last_weight
        FROM asked_users a, LATERAL exercise_progress(a.user_id, '{BOUND_SLUG}') p,
             LATERAL exercise_tonnage(a.user_id, '{BOUND_SLUG}') n, LATERAL last_exercise_log(a.user_id, '{BOUND_SLUG}') l
        WHERE p.workout_date = n.workout_date""")


def refreshed_progress(t):
    """Progress from partial sums: those of the older workouts, then the days of the newer ones taken over by a save."""
    kept = partials.SessionPartials(t.spark, shared_dir(t.spark, "partials"))
    newer = F.col("workout_date") >= REFRESHED_FROM
    kept.save(0, t.replaced(workouts=t["workouts"].where(~newer)))
    kept.save(1, t, t["workouts"].where(newer).select("user_id", "workout_date"))
    return kept.points(t).select("user_id", "slug", "workout_date", "max_weight", "reps", "sets_count")


def message_context(t):
    c = reports.message_context(t, t["messages"])
    return c.select("msg_id", "n_chars", F.md5("context").alias("context_md5"))


def full_log(t):
    return reports.full_log(t).select("user_id", "workout_id", "position", "block")


def visible_rows(t):
    return quality.visible_rows(t).select("workout_id", "exercise_id", "set_number", "reps")


def _on(fn):
    """Query over the messages."""
    return lambda t: fn(t, t["messages"])


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # scans and sources
    "scan_log": history.scan_log,
    "scan_catalog": lambda t: catalog.alias_entries(t["catalog_source"]),
    "values_source": lambda t: catalog.values_source(t, LITERAL_SETS),
    "catalog_by_muscle": catalog.catalog_by_muscle,
    "nutrition_map": nutrition_map,
    # predicates and scalar rules
    "active_goals": reports.active_goals,
    "current_injuries": reports.current_injuries,
    "active_bans": reports.active_bans,
    "active_split": reports.active_split,
    "split_focus_rpc": split_focus("app"),
    "split_focus_bot": split_focus("chat"),
    "focus_to_muscles": focus_to_muscles,
    "day_label": lambda t: t["workouts"].select(
        "workout_id", "workout_date", rules.day_label(F.col("workout_date")).alias("day_label")),
    "date_label": lambda t: t["workouts"].select(
        "workout_id", rules.date_label(F.col("workout_date")).alias("date_label")),
    "session_label": history.session_labels,
    "set_label": set_labels,
    "is_bodyweight": lambda t: t["exercises"].select(
        "slug", "equipment", rules.is_bodyweight(F.col("equipment")).alias("is_bodyweight")),
    "muscle_order": muscle_order,
    "parse_decimal": parse_decimal,
    "log_summary_text": _on(messages.log_summary_text),
    "allowed_users": allowed_users,
    "profile_or_fallback": profile_or_fallback,
    "local_date": local_date,
    "picker_subtitle": lambda t: sessions.picker_subtitles(t, AS_OF),
    "summary_title": sessions.summary_titles,
    "entry_preview": entry_preview,
    # joins
    "log_join": history.full_join,
    "trained_exercises": history.trained_exercises,
    "visible_rows": visible_rows,
    "seed_missing": seed_missing,
    "orphan_rows": quality.orphan_rows,
    # aggregations
    "muscle_group_sessions": history.muscle_group_sessions,
    "exercise_sessions": history.exercise_sessions,
    "focus_counts": history.focus_counts,
    "max_scalar": history.last_trained_date,
    "uniform_sets": reports.uniform_sets,
    "all_zero_weight": history.all_zero_weight,
    "tonnage_display": history.tonnage_display,
    # named analytics
    "exercise_progress": history.exercise_progress,
    "pinned_exercise_progress": lambda t: history.exercise_progress(t, slug=BOUND_SLUG),
    "exercise_records": history.exercise_records,
    "exercise_tonnage": history.exercise_tonnage,
    "exercise_progress_stored": on_stored_log(history.exercise_progress),
    "exercise_tonnage_stored": on_stored_log(history.exercise_tonnage),
    "last_exercise_log_stored": on_stored_log(sessions.last_exercise_log),
    "exercise_progress_refreshed": refreshed_progress,
    "table_functions": called_functions,
    "last_exercise_log": sessions.last_exercise_log,
    "last_log_capped": lambda t: sessions.last_exercise_log(t, cap=40),
    "last_workout_summary": sessions.last_workout_summary,
    "today_overview": lambda t: sessions.today_overview(t, AS_OF),
    "today_overview_last_day": sessions.today_overview,
    "muscle_session_overview": lambda t: sessions.muscle_session_overview(t, AS_OF).drop("bodyweight"),
    "muscle_session_overview_last_day": lambda t: sessions.muscle_session_overview(t).drop("bodyweight"),
    "session_picker": lambda t: sessions.session_picker(t, AS_OF),
    "recent_sessions": history.recent_sessions,
    "history_window": lambda t: history.history_window(t).drop("created_at"),
    "chart_domain": history.chart_domain,
    "repeat_last": sessions.repeat_last,
    "no_history_exercises": sessions.no_history_exercises,
    "newest_workout_per_exercise": sessions.newest_workout_per_exercise,
    # reports
    "set_detail": reports.set_detail,
    "key_lift_progression": lambda t: reports.key_lift_progression(t).drop("ord"),
    "focused_progression": _on(reports.focused_progression),
    "full_log": full_log,
    "profile_snapshot": reports.profile_snapshot,
    "alias_reference": lambda t: reports.alias_reference(t).drop("ord"),
    "matched_lines": _on(reports.matched_lines),
    "message_context": message_context,
    "allowed_catalog": reports.allowed_catalog,
    "next_load": reports.next_load,
    # messages
    "normalized_text": lambda t: messages.normalized_text(t["messages"]),
    "resolve_exercises": _on(messages.resolve_exercises),
    "parse_numbers": lambda t: messages.numbers(t["messages"]),
    "parse_date": lambda t: messages.dates(t["messages"]),
    "classify_message": _on(messages.classify_messages),
    "parsed_log": _on(messages.parsed_log),
    "route_messages": _on(messages.route_messages),
    "validate_log": lambda t: messages.validate_log(t, t["log_events"]),
    "structured_log": lambda t: messages.structured_log(t, payloads(t)),
    # write path
    "attach_workouts": attach(),
    "attach_workouts_bot": attach("chat"),
    "attach_workouts_existing": attach(existing=True),
    "attach_workouts_bot_existing": attach("chat", existing=True),
    "continue_recent": attach(existing=True, as_of=LIVE_DAY),
    "replace_sets": replace_sets,
    "log_receipt": log_receipt,
    "upsert_profile": upsert_profile,
    "seed_catalog": seed_catalog,
    "seed_plain": seed_plain,
    "replace_history": replace_history,
    "replace_stored_history": replace_stored_history,
    "cross_join_seed": lambda t: writes.baseline_sets(t, LITERAL_SETS),
    "cascade_delete": cascade_delete,
    "write_log": write_log,
    # data quality
    "dup_keys": quality.dup_keys,
    "domain_violations": quality.domain_violations,
    "range_violations": quality.range_violations,
    "null_violations": quality.null_violations,
    "defaults_applied": defaults_applied,
    "catalog_drift": catalog_drift,
    # streaming
    "stream_ingest": live.stream_ingest,
    "stream_daily_tonnage": live.stream_daily_tonnage,
    "stream_last_log": live.stream_last_log,
    "stream_upsert": live.stream_upsert,
    "stream_last_log_batches": in_batches(live.stream_last_log),
    "stream_upsert_batches": in_batches(live.stream_upsert),
    "stream_dedup": live.stream_dedup,
    "stream_training_bouts": live.stream_training_bouts,
    "training_bouts": lambda t: live.training_bouts(t, t["log_events"]),
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Tables(spark, sf_dir))
