"""From chat messages and form entries to log records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.functions import parsing, rules
from liftlake.session import MAX_BROADCAST_ROWS, cut_lineage
from liftlake.sources.catalog import ENTRIES, MAX_LITERAL_ALIASES, alias_matcher, alias_table

# What the columns of a stored set hold: smallint counts, decimal(6,2) weights. Beyond, saving fails.
MAX_COUNT = 32_767
MAX_WEIGHT = 10_000


def normalized_text(messages: DataFrame) -> DataFrame:
    return messages.select(
        "msg_id", parsing.normalized(F.col("text")).alias("parser_text"),
        F.trim(parsing.normalized(F.col("text"))).alias("resolver_text"))


def with_slugs(t, messages: DataFrame, limit: int = MAX_LITERAL_ALIASES) -> DataFrame:
    """Messages with ``slugs``: the exercises named in the text, in acceptance order.

    A catalog within ``limit`` aliases is matched row by row without any shuffle.
    A larger one goes through equi-joins of text pieces with alias beginnings.
    """
    matcher = alias_matcher(t, limit)
    if matcher is None:
        return _with_slugs_by_join(t, messages)
    if not matcher.entries:
        return messages.withColumn("slugs", F.array().cast("array<string>"))
    # A constant: as a column it would be copied into every row.
    entries = F.from_json(F.lit(json.dumps(matcher.entries)), ENTRIES)
    return messages.withColumn("slugs", parsing.resolve_slugs(F.col("text"), matcher, entries))


def alias_hits(t, texts: DataFrame, key: list[str]) -> DataFrame:
    """Occurrences (key, lo, alias row) of the aliases of any dictionary in the texts (key, norm).

    The dictionary is walked like a trie, by beginnings of doubling length. Every
    place of a text is looked up once with the beginning of the shortest alias; only
    places that begin longer aliases as well are looked up again with twice as many
    characters. At each length the aliases between it and its double are candidates.
    """
    table = alias_table(t["catalog_source"]).select("alias", "slug", "size", "ord", "pos")
    low, high, many = table.agg(F.min("size"), F.max("size"), F.count(F.lit(1))).first()
    held = F.broadcast if many <= MAX_BROADCAST_ROWS else lambda df: df
    found = []
    if low is None:
        return texts.select(*key, F.lit(0).alias("lo")).join(table, F.lit(False))
    n = 1 << (low.bit_length() - 1)
    places = texts.where(F.length("norm") >= n).select(
        *key, "norm", F.explode(F.sequence(F.lit(0), F.length("norm") - n)).alias("lo"))
    while True:
        begun = table.withColumn("beginning", F.substring("alias", 1, n)).where(F.col("size") >= n)
        beginnings = begun.groupBy("beginning").agg(
            F.collect_list(F.when(F.col("size") < 2 * n, F.struct("alias", "slug", "size", "ord", "pos"))).alias("here"),
            F.bool_or(F.col("size") >= 2 * n).alias("longer"))
        # What is shuffled is a place and the few characters read at it, not the text.
        piece = F.substring("norm", F.col("lo") + 1, F.lit(min(2 * n, high)))
        looked_up = places.select(*key, "lo", piece.alias("piece"), F.expr(f"substring(norm, lo + 1, {n})").alias("beginning")) \
            .join(held(beginnings), "beginning")
        if 2 * n > high:
            found.append(looked_up)
            break
        looked_up = cut_lineage(looked_up)
        found.append(looked_up)
        n *= 2
        places = looked_up.where("longer").select(*key, "lo").join(texts, key).where(F.length("norm") >= F.col("lo") + n)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(*key, "lo", "piece", F.inline("here")).where(F.startswith("piece", F.col("alias"))).drop("piece")


def _with_slugs_by_join(t, messages: DataFrame) -> DataFrame:
    """Any catalog size: the occurrences are folded per message, where a message is bounded by its own text.

    Rows that repeat an id with another text keep their own matches.
    """
    norm = F.trim(parsing.normalized(F.col("text")))
    keyed = messages.withColumn("text_key", F.md5(norm.cast("binary")))
    key = ["msg_id", "text_key"]
    texts = keyed.select(*key, norm.alias("norm")).distinct()
    hits = alias_hits(t, texts, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("size")).alias("neg_size"), "ord", "pos", "lo", (F.col("lo") + F.col("size")).alias("hi"), "slug",
    ))).alias("spans"))
    found = hits.select(*key, parsing.accepted_slugs(F.col("spans")).alias("slugs"))
    return keyed.join(found, key, "left").withColumn(
        "slugs", F.coalesce("slugs", F.array().cast("array<string>"))).drop("text_key")


def each_slug(t, messages: DataFrame, *columns) -> DataFrame:
    """One row per slug of a message with its place in acceptance order."""
    # The CASE keeps Spark from adding a filter that would match every text twice.
    slugs = F.when(F.col("slugs").isNotNull(), F.col("slugs"))
    return with_slugs(t, messages).select("msg_id", *columns, F.posexplode(slugs).alias("position", "slug"))


def resolve_exercises(t, messages: DataFrame) -> DataFrame:
    """Slugs per message with their place in acceptance order."""
    return each_slug(t, messages)


def numbers(messages: DataFrame) -> DataFrame:
    return messages.select("msg_id", parsing.parse_numbers(F.col("text")).alias("n")).where("n is not null").select(
        "msg_id", "n.weight_kg", "n.reps", "n.sets")


def dates(messages: DataFrame) -> DataFrame:
    return messages.select("msg_id", parsing.parse_date(F.col("text"), F.col("msg_date")).alias("workout_date"))


def _parsed(t, messages: DataFrame) -> DataFrame:
    """All messages with slugs, numbers and the is-a-log flag."""
    text = F.trim("text")
    found = with_slugs(t, messages).withColumn("n", parsing.parse_numbers(text))
    return found.withColumn("is_log", parsing.is_workout_log(text, F.size("slugs") > 0, F.col("n").isNotNull()))


def _record() -> list:
    """Columns of the log record of a parsed message."""
    high = F.col("n").isNotNull() & (F.size("slugs") == 1)
    return [
        F.get("slugs", F.lit(0)).alias("slug"),
        F.coalesce("n.weight_kg", F.lit(0.0)).alias("weight_kg"),
        F.coalesce("n.reps", F.lit(0)).alias("reps"),
        F.coalesce("n.sets", F.lit(0)).alias("sets"),
        parsing.parse_date(F.trim("text"), F.col("msg_date")).alias("workout_date"),
        F.when(high, "high").otherwise("medium").alias("confidence"),
    ]


def classify_messages(t, messages: DataFrame) -> DataFrame:
    return _parsed(t, messages).select("msg_id", "is_log")


def parsed_log(t, messages: DataFrame) -> DataFrame:
    """Log record per message that reports a workout.

    Expanding an array of zero or one records, rather than filtering, keeps the
    text matching from being pushed down and done a second time.
    """
    record = F.when(F.col("is_log"), F.array(F.struct(*_record())))
    return _parsed(t, messages).select("msg_id", "user_id", F.inline(record))


def _names(t) -> DataFrame:
    return t["catalog_source"].select("slug", F.col("canonical").alias("name"))


def _summary(name, weight, reps, sets, day, confidence):
    return F.when(
        (confidence == "medium") & (weight == 0), F.concat(name, F.lit(" (уточни вес и повторы)"))
    ).otherwise(F.concat(name, F.lit(": "), rules.loaded_label(weight, reps, sets, rules.general_number),
                         F.lit(" ("), day.cast("string"), F.lit(")")))


def log_summary_text(t, messages: DataFrame) -> DataFrame:
    """One-line summary of each parsed log."""
    return parsed_log(t, messages).join(_names(t), "slug").select("msg_id", _summary(
        F.col("name"), F.col("weight_kg"), F.col("reps"), F.col("sets"),
        F.col("workout_date"), F.col("confidence")).alias("summary"))


def validate(t, entries: DataFrame) -> DataFrame:
    """Entries with ``reason``: null when accepted, else the first failed check.

    Needs exercise_id, weight_kg, reps and sets_count; adds muscle_group.
    """
    catalog = t["exercises"].select(
        "exercise_id", "slug", "muscle_group", rules.is_bodyweight(F.col("equipment")).alias("bodyweight"))
    return entries.join(catalog, "exercise_id", "left").withColumn("reason", _reason()).drop("bodyweight")


def _reason():
    return (
        F.when(F.coalesce(F.col("sets_count") <= 0, F.lit(True)), "bad_sets")
        .when(F.coalesce(F.col("reps") <= 0, F.lit(True)), "bad_reps")
        .when(F.coalesce(F.col("weight_kg") < 0, F.lit(True)), "bad_weight")
        .when(F.col("slug").isNull(), "unknown_exercise")
        .when((F.col("weight_kg") == 0) & ~F.col("bodyweight"), "zero_weight")
    )


def validate_log(t, events: DataFrame) -> DataFrame:
    return validate(t, events).select("event_id", F.col("reason").isNull().alias("accepted"), "reason")


def route_messages(t, messages: DataFrame) -> DataFrame:
    """What happens to each message: pass_through, saved, save_failed or clarify.

    Only a high-confidence log is saved, and only if it passes validation.
    """
    parsed = _parsed(t, messages).select("msg_id", "is_log", *_record())
    known = t["exercises"].select(
        F.col("slug").alias("known_slug"), rules.is_bodyweight(F.col("equipment")).alias("bodyweight"))
    rows = (
        parsed.join(known, F.col("slug") == F.col("known_slug"), "left")
        .withColumn("slug_ok", F.col("known_slug"))
        .join(_names(t).withColumnRenamed("slug", "name_slug"), F.col("slug") == F.col("name_slug"), "left")
    )
    can_save = (
        F.col("reps").between(1, MAX_COUNT) & F.col("sets").between(1, MAX_COUNT) & F.col("slug_ok").isNotNull()
        & (F.col("weight_kg") < MAX_WEIGHT)
        & ((F.col("weight_kg") > 0) | ((F.col("weight_kg") == 0) & F.col("bodyweight")))
    )
    outcome = (
        F.when(~F.col("is_log"), "pass_through")
        .when(F.col("confidence") == "medium", "clarify")
        .when(can_save, "saved").otherwise("save_failed")
    )
    summary = _summary(F.coalesce("name", "slug"), F.col("weight_kg"), F.col("reps"), F.col("sets"),
                       F.col("workout_date"), F.col("confidence"))
    return rows.select("msg_id", outcome.alias("outcome"),
                       F.when(F.col("is_log"), summary).alias("summary"))


def structured_log(t, entries: DataFrame) -> DataFrame:
    """Button payloads ``log:s:slug:weight:reps:sets`` as high-confidence records.

    Payloads without exactly six parts, of another kind, or with unreadable numbers give no row.
    """
    part = lambda i: F.get("parts", i)
    parsed = (
        entries.withColumn("parts", F.split("payload", ":"))
        .where(F.startswith("payload", F.lit("log:s:")) & (F.size("parts") == 6))
        .select("entry_id", "user_id", "workout_date", part(2).alias("slug"),
                rules.parse_number(part(3)).alias("weight_kg"),
                part(4).try_cast("int").alias("reps"), part(5).try_cast("int").alias("sets"))
        .where("weight_kg is not null and reps is not null and sets is not null")
    )
    name = F.coalesce("name", "slug")
    return parsed.join(_names(t), "slug", "left").select(
        "entry_id", "user_id", "slug", name.alias("name"), "weight_kg", "reps", "sets", "workout_date",
        F.lit("high").alias("confidence"),
        F.concat(name, F.lit(" "), rules.general_number(F.col("weight_kg")), F.lit("×"), F.col("reps").cast("string"),
                 F.lit("×"), F.col("sets").cast("string")).alias("raw_text"))
