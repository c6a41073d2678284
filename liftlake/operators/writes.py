"""The write path: attaching log events to workouts and set-based changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlake.functions import rules
from liftlake.operators.common import for_users, one_per_key
from liftlake.operators.messages import validate
from liftlake.session import broadcast_if_small, cut_lineage
from liftlake.sources.flatlog import FlatLog, flat_rows

# --- Fixed values -----------------------------------------------------------
CANDIDATE_WORKOUTS = 5   # newest workouts of a day an event may attach to
CONTINUE_HOURS = 6       # age up to which a workout in progress is continued
IN_PROGRESS = "In progress"
# Older spellings of a focus that the app rule also accepts.
FOCUS_VARIANTS = {"Chest + Biceps": ["Chest"], "Back + Triceps": ["Back"]}
# ----------------------------------------------------------------------------

# A day is replayed within one row up to this many events, beyond it round by round.
MAX_FOLDED_EVENTS = 256
# A block of the replay scan holds two to this power of events, a group that many blocks.
BLOCK_BITS = 8

_DAY = ["user_id", "workout_date"]
_WORKOUT = "struct<focus:string,key:string>"
_STATES = "array<struct<p:int,last:array<bigint>,first:bigint,open:bigint>>"


def accepted_events(t, events: DataFrame, rule: str = "app") -> DataFrame:
    """Valid events with the focus they belong to and their place in time."""
    return (
        validate(t, events).where("reason is null")
        .withColumn("event_focus", rules.split_focus(F.col("muscle_group"), rule))
        .withColumn("at", F.struct("ts", "event_id"))
        .drop("reason", "muscle_group")
    )


def _focus_matches(workout_focus: Column, event_focus: Column, rule: str) -> Column:
    same = (workout_focus == event_focus) | (workout_focus == rules.FOCUS_UNKNOWN)
    if rule == "app":
        for focus, variants in FOCUS_VARIANTS.items():
            same = same | ((event_focus == focus) & workout_focus.isin(variants))
    return F.coalesce(same, F.lit(False))


def _match(visible: Column, event_focus: Column, rule: str) -> Column:
    """Key of the newest visible workout that takes the event, else null."""
    return F.get(F.filter(visible, lambda w: _focus_matches(w["focus"], event_focus, rule)), 0)["key"]


def _new_key(focus: Column) -> Column:
    return F.concat_ws("|", F.col("user_id").cast("string"), F.col("workout_date").cast("string"), focus)


def _visible_workouts(existing: DataFrame) -> DataFrame:
    """Newest workouts per (user, date) as an array, newest first, with the newest's creation time."""
    order = Window.partitionBy(*_DAY).orderBy(F.desc("created_at"), F.desc("workout_id"))
    newest = existing.withColumn("n", F.row_number().over(order)).where(F.col("n") <= CANDIDATE_WORKOUTS)
    return newest.groupBy(*_DAY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                "n", F.col("split_focus").alias("focus"), F.col("workout_id").cast("string").alias("key")))),
            lambda w: F.struct(w["focus"].alias("focus"), w["key"].alias("key")),
        ).alias("visible"),
        F.max("created_at").alias("newest_at"),
    )


def attach_workouts(t, events: DataFrame, rule: str = "app", existing: DataFrame | None = None,
                    as_of=None, fold_limit: int = MAX_FOLDED_EVENTS) -> DataFrame:
    """Workout each accepted event is written to.

    In time order an event joins the newest of the few newest workouts of its
    (user, date) whose focus fits; else, on the day ``as_of``, the newest one if
    it is in progress and young; else a new workout with its own focus.

    While the number of visible workouts cannot exceed the candidate limit, the
    outcome follows from one aggregate per (user, date): from the first event
    that creates a 'Logged' workout on, everything joins that one; before it,
    each focus has its own workout. Days where the limit can bind are replayed:
    those of up to ``fold_limit`` events within a row each, larger ones by a
    fixed number of steps over all such days at once, however many workouts they create.
    """
    base = accepted_events(t, events, rule)
    no_key = F.lit(None).cast("string")
    visible = None
    if existing is None:
        base = base.withColumns({"old_key": no_key, "n_old": F.lit(0), "open_key": no_key})
    else:
        touched = base.select(*_DAY).distinct()
        visible = _visible_workouts(existing.join(touched, _DAY, "left_semi"))
        base = base.join(visible, _DAY, "left").withColumn(
            "old_key", _match(F.col("visible"), F.col("event_focus"), rule))
        newest = F.get("visible", F.lit(0))
        open_now = (
            (F.col("workout_date") == F.lit(as_of).cast("date")) & (newest["focus"] == IN_PROGRESS)
            & (F.col("ts") <= F.col("newest_at") + F.expr(f"interval {CONTINUE_HOURS} hours"))
        ) if as_of is not None else F.lit(False)
        base = base.withColumns({
            "n_old": F.coalesce(F.size("visible"), F.lit(0)),
            "open_key": F.when(open_now & F.col("old_key").isNull(), newest["key"]),
        }).drop("visible", "newest_at")
    if existing is not None or rule != "app":
        base = cut_lineage(base)  # read again by every branch below

    # Events continuing a workout in progress precede every creation of their day.
    creates = F.col("old_key").isNull() & F.col("open_key").isNull()
    days = base.groupBy(*_DAY).agg(
        F.min(F.when(creates & (F.col("event_focus") == rules.FOCUS_UNKNOWN), F.col("at"))).alias("t0"),
        (F.max("n_old") + F.size(F.collect_set(F.when(creates, F.col("event_focus"))))  # at most one per focus
         > CANDIDATE_WORKOUTS).alias("binds"),
        F.count(F.lit(1)).alias("n_events"),
    )
    placed = base.join(days, _DAY)
    unknown = F.lit(rules.FOCUS_UNKNOWN)
    closed = placed.where("not binds or open_key is not null").withColumn(
        "workout_key",
        F.when(F.col("open_key").isNotNull(), F.col("open_key"))
        .when(F.col("at") >= F.col("t0"), _new_key(unknown))
        .otherwise(F.coalesce("old_key", _new_key(F.col("event_focus")))),
    )
    if existing is None and rule == "app":  # four foci at most: the limit never binds
        return _placed_columns(closed)
    binding = placed.where("binds and open_key is null")
    parts = [closed, _fold_days(binding.where(F.col("n_events") <= fold_limit), visible, rule)]
    if not days.where(F.col("binds") & (F.col("n_events") > fold_limit)).isEmpty():
        parts += _replay(binding.where(F.col("n_events") > fold_limit), visible, rule)
    return reduce(DataFrame.unionByName, [_placed_columns(df) for df in parts])


_PLACED = ["event_id", "user_id", "ts", "workout_date", "exercise_id", "slug", "weight_kg", "reps", "sets_count",
           "event_focus"]


def _placed_columns(df: DataFrame) -> DataFrame:
    return df.select(*_PLACED, "workout_key")


def _with_visible(days: DataFrame, visible: DataFrame | None) -> DataFrame:
    """Days with the workouts an event may attach to at the start, none without a stored log."""
    empty = F.array().cast(f"array<{_WORKOUT}>")
    if visible is None:
        return days.withColumn("visible", empty)
    return days.join(visible.select(*_DAY, "visible"), _DAY, "left").withColumn(
        "visible", F.coalesce("visible", empty))


def _created_key(focus: Column, created: Column, event_id: Column) -> Column:
    """Key of a new workout; a focus created again on the same day needs one of its own."""
    return F.concat_ws("|", _new_key(focus), F.when(F.array_contains(created, focus), event_id.cast("string")))


def _fold_days(events: DataFrame, visible: DataFrame | None, rule: str) -> DataFrame:
    """Replay each day within one row: its events in time order and the workouts seen so far."""
    columns = [c for c in _PLACED if c not in _DAY]
    daily = events.groupBy(*_DAY).agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").alias("order"), *columns))).alias("events"))
    daily = _with_visible(daily, visible)
    start = F.struct(
        F.col("visible").alias("visible"), F.array().cast("array<string>").alias("created"),
        F.array().cast("array<string>").alias("keys"))

    def attach(state: Column, e: Column) -> Column:
        hit = _match(state["visible"], e["event_focus"], rule)
        key = _created_key(e["event_focus"], state["created"], e["event_id"])
        new = F.struct(e["event_focus"].alias("focus"), key.alias("key"))
        return F.when(hit.isNotNull(), F.struct(
            state["visible"].alias("visible"), state["created"].alias("created"),
            F.array_append(state["keys"], hit).alias("keys"),
        )).otherwise(F.struct(
            F.slice(F.concat(F.array(new), state["visible"]), 1, CANDIDATE_WORKOUTS).alias("visible"),
            F.array_append(state["created"], e["event_focus"]).alias("created"),
            F.array_append(state["keys"], key).alias("keys"),
        ))

    keys = F.aggregate("events", start, attach)["keys"]
    return daily.select(*_DAY, F.inline(F.arrays_zip(F.col("events").alias("e"), keys.alias("k")))).select(
        *_DAY, *[F.col(f"e.{c}").alias(c) for c in columns], F.col("k").alias("workout_key"))


def _replay(events: DataFrame, visible: DataFrame | None, rule: str) -> list[DataFrame]:
    """Place the events of large days where the candidate limit binds.

    A few rounds, each one aggregation over all open days, find a day's first
    creations. Whatever was stored is then out of sight, and what follows under the
    chat rule needs no more rounds (``_cycle``); under the app rule nothing follows.
    """
    keep = [*_PLACED, "at"]
    remaining = cut_lineage(events.select(*keep))
    state = _with_visible(remaining.select(*_DAY).distinct(), visible).withColumn(
        "created", F.array().cast("array<string>"))
    placed = []
    for _ in range(CANDIDATE_WORKOUTS):
        # One row per open day; broadcast after a count, so a hot day is not pulled into one task.
        current = remaining.join(broadcast_if_small(state), _DAY).withColumn(
            "workout_key", _match(F.col("visible"), F.col("event_focus"), rule))
        creation = current.where("workout_key is null").groupBy(*_DAY).agg(
            F.min(F.struct("at", "event_focus")).alias("c"))
        key = _created_key(F.col("c.event_focus"), F.col("created"), F.col("c.at.event_id"))
        state = cut_lineage(
            state.join(creation, _DAY).select(
                *_DAY, F.col("c.at").alias("since"),
                F.slice(F.array_insert("visible", 1, F.struct(
                    F.col("c.event_focus").alias("focus"), key.alias("key"))), 1, CANDIDATE_WORKOUTS).alias("visible"),
                F.array_union("created", F.array("c.event_focus")).alias("created"),
            ))
        split = current.select(*keep, "workout_key").join(
            broadcast_if_small(state.select(*_DAY, "since")), _DAY, "left")
        placed.append(split.where("since is null or at < since"))
        if state.isEmpty():
            return placed
        remaining = cut_lineage(split.where("at >= since").select(*keep))
    takes_all = F.exists("visible", lambda w: w["focus"] == rules.FOCUS_UNKNOWN)
    settled = remaining.join(broadcast_if_small(state.where(takes_all)), _DAY).withColumn(
        "workout_key", _match(F.col("visible"), F.col("event_focus"), rule))
    return [*placed, settled, _cycle(remaining, state.where(~takes_all))]


def _cycle(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events of days whose visible workouts were all created on the day, by a scan over blocks of events.

    The visible workouts then have different foci, and of the foci that chat events
    have only two can create a workout: the one named focus that is out of sight,
    and 'Logged', after which everything fits. Each creation of the missing focus
    pushes the oldest workout out of sight, whose focus is missing next, so foci are
    created in a fixed circle: the place in it is all that passes from one event to
    the next, with the newest workout of each focus. A block of events is summed up
    as what it does to each of the places; the sums of a day are applied in order, first
    those of blocks of blocks, which gives every block the state it starts from.
    """
    named = rules.string_array(sorted(rules.FOCUS_CHAT.values()))
    # The missing focus comes first in the circle, then the visible ones from old to new.
    oldest_first = F.reverse(F.transform("visible", lambda w: w["focus"]))
    days = state.select(
        *_DAY, F.concat(F.array_except(named, oldest_first), oldest_first).alias("circle"),
        F.concat(F.array(F.lit(None).cast("string")), F.reverse(F.transform("visible", lambda w: w["key"]))).alias("keys"))
    slots = len(rules.FOCUS_CHAT)
    order = [*_DAY, "at"]
    numbered = cut_lineage(
        events.join(broadcast_if_small(days.select(*_DAY, "circle")), _DAY)
        .withColumn("slot", F.array_position("circle", F.col("event_focus")).cast("int") - 1).drop("circle")
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()))
    block = F.shiftright("place", BLOCK_BITS)

    def start(p: Column) -> Column:
        last = F.array_repeat(F.lit(None).cast("bigint"), slots)
        return F.struct(p.cast("int").alias("p"), last.alias("last"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("open"))

    def step(s: Column, e: Column) -> Column:
        """State after an event: place in the circle, last creation of each focus, first one of the missing focus, that of 'Logged'."""
        creates = s["open"].isNull() & (e["slot"] == s["p"])
        return F.struct(
            F.when(creates, (s["p"] + 1) % slots).otherwise(s["p"]).alias("p"),
            F.when(creates, F.transform(s["last"], lambda x, i: F.when(i == e["slot"], e["event_id"]).otherwise(x)))
            .otherwise(s["last"]).alias("last"),
            F.when(creates & (e["slot"] == 0), F.coalesce(s["first"], e["event_id"])).otherwise(s["first"]).alias("first"),
            F.when(e["slot"] < 0, F.coalesce(s["open"], e["event_id"])).otherwise(s["open"]).alias("open"))

    def apply(s: Column, effects: Column) -> Column:
        """State after a block, from what the block does to the state's place."""
        done = F.get(effects, s["p"])
        return F.when(s["open"].isNotNull(), s).otherwise(F.struct(
            done["p"].alias("p"),
            F.transform(F.arrays_zip(done["last"].alias("a"), s["last"].alias("b")), lambda x: F.coalesce(x["a"], x["b"])).alias("last"),
            F.coalesce(s["first"], done["first"]).alias("first"), done["open"].alias("open")))

    def effects(items: Column, one) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda p: F.aggregate(items, start(p), one))

    def in_order(*columns) -> Column:
        return F.array_sort(F.collect_list(F.struct(*columns)))

    small = numbered.groupBy(*_DAY, block.alias("block")).agg(in_order("place", "event_id", "slot").alias("items")).select(
        *_DAY, "block", effects(F.col("items"), step).alias("effects"))
    small = cut_lineage(small)
    large = F.shiftright("block", BLOCK_BITS)
    grouped = small.groupBy(*_DAY, large.alias("group")).agg(in_order("block", "effects").alias("items"))

    def starts(rows: DataFrame, items: Column, first: Column, name: str) -> DataFrame:
        """The state before each of the items of a row."""
        found = F.aggregate(items, F.struct(first.alias("s"), F.array().cast(_STATES).alias("before")), lambda acc, x: F.struct(
            apply(acc["s"], x["effects"]).alias("s"), F.array_append(acc["before"], acc["s"]).alias("before")))["before"]
        return rows.select(*_DAY, F.inline(F.arrays_zip(items.alias("x"), found.alias("s")))).select(
            *_DAY, F.col(f"x.{name}").alias(name), F.col("s").alias("start"))

    whole = grouped.select(*_DAY, "group", effects(F.col("items"), lambda s, x: apply(s, x["effects"])).alias("effects"))
    by_day = whole.groupBy(*_DAY).agg(in_order("group", "effects").alias("items"))
    of_group = starts(by_day, F.col("items"), start(F.lit(0)), "group")
    of_block = starts(grouped.join(of_group, [*_DAY, "group"]), F.col("items"), F.col("start"), "block")

    # Each block once more, from its state: the key of every event.
    columns = [c for c in _PLACED if c not in _DAY]
    rows = numbered.groupBy(*_DAY, block.alias("block")).agg(in_order("place", "slot", *columns).alias("items"))
    rows = rows.join(of_block, [*_DAY, "block"]).join(broadcast_if_small(days), _DAY)
    unknown = F.lit(rules.FOCUS_UNKNOWN)

    def key(s: Column, e: Column) -> Column:
        made = F.get(s["last"], e["slot"])
        # Only the missing focus has had no workout on the day; its first one needs no key of its own.
        again = F.when((e["slot"] != 0) | (made != s["first"]), made.cast("string"))
        return (
            F.when(s["open"].isNotNull(), _new_key(unknown))
            .when(made.isNull(), F.get(F.col("keys"), e["slot"]))
            .otherwise(F.concat_ws("|", _new_key(e["event_focus"]), again)))

    def attach(acc: Column, e: Column) -> Column:
        after = step(acc["s"], e)
        return F.struct(after.alias("s"), F.array_append(acc["keys"], key(after, e)).alias("keys"))

    found = F.aggregate("items", F.struct(F.col("start").alias("s"), F.array().cast("array<string>").alias("keys")), attach)["keys"]
    return rows.select(*_DAY, F.inline(F.arrays_zip(F.col("items").alias("e"), found.alias("k")))).select(
        *_DAY, *[F.col(f"e.{c}").alias(c) for c in columns], F.col("k").alias("workout_key"))


def replace_sets(t, attached: DataFrame, existing_sets: DataFrame | None = None) -> DataFrame:
    """Sets after the events: the last log per (workout, exercise) wins and expands to equal sets.

    ``replaced`` tells whether an earlier log or stored sets were overwritten.
    """
    last = attached.groupBy("workout_key", "exercise_id").agg(
        F.max_by(F.struct("weight_kg", "reps", "sets_count"), F.struct("ts", "event_id")).alias("last"),
        (F.count(F.lit(1)) > 1).alias("replaced"),
    )
    if existing_sets is not None:
        last = _with_stored(last, existing_sets).withColumn("replaced", F.col("replaced") | F.col("stored"))
    return last.select(
        "workout_key", "exercise_id",
        F.explode(F.sequence(F.lit(1), F.col("last.sets_count"))).alias("set_number"),
        F.col("last.weight_kg").cast("double").alias("weight_kg"),
        F.col("last.reps").alias("reps"), "replaced")


def _with_stored(df: DataFrame, existing_sets: DataFrame) -> DataFrame:
    """Flag rows whose (workout, exercise) already holds sets."""
    stored = existing_sets.select(
        F.col("workout_id").cast("string").alias("workout_key"), "exercise_id", F.lit(True).alias("stored")).distinct()
    return df.join(stored, ["workout_key", "exercise_id"], "left").withColumn(
        "stored", F.coalesce("stored", F.lit(False)))


def log_receipt(attached: DataFrame, existing_sets: DataFrame | None = None, rule: str = "app") -> DataFrame:
    """Answer per event: workout, whether sets were replaced, and the event's own focus.

    The chat rule never reports a replacement.
    """
    out = ["event_id", "workout_key", "replaced", F.col("event_focus").alias("split_focus")]
    if rule != "app":
        return attached.withColumn("replaced", F.lit(False)).select(*out)
    keys = ["workout_key", "exercise_id"]
    at = F.struct("ts", "event_id")
    first = attached.groupBy(*keys).agg(F.min(at).alias("first_at"))
    if existing_sets is not None:
        first = _with_stored(first, existing_sets)
    else:
        first = first.withColumn("stored", F.lit(False))
    return attached.join(first, keys).withColumn(
        "replaced", F.col("stored") | (at > F.col("first_at"))).select(*out)


def log_sessions(t, events: DataFrame, focus_rule: str = "app", existing=None, existing_sets=None,
                 as_of=None) -> tuple[DataFrame, DataFrame]:
    """Whole write path: receipts per event and the resulting sets."""
    attached = attach_workouts(t, events, focus_rule, existing, as_of)
    return log_receipt(attached, existing_sets, focus_rule), replace_sets(t, attached, existing_sets)


def apply_sets(sets: DataFrame, new_sets: DataFrame) -> DataFrame:
    """Stored sets with every (workout, exercise) of ``new_sets`` replaced."""
    keys = ["workout_key", "exercise_id"]
    kept = sets.join(new_sets.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new_sets.select(*kept.columns))


def upsert_profile(profile: DataFrame, updates: DataFrame, now=None) -> DataFrame:
    """Insert new users; for known ones change weight, goal, notes and nutrition only.

    Of several updates of a user the newest counts, by ``updated_at`` where updates
    carry it, then by their values. Where profiles carry ``updated_at``, a changed one gets ``now`` (a column or value;
    by default the update's own).
    """
    changed = ["weight_kg", "goal", "notes", "nutrition"]
    old = profile.withColumn("known", F.lit(True)).alias("o")
    stamped = ["updated_at"] if "updated_at" in updates.columns else []
    new = one_per_key(updates, ["user_id"], newest=stamped).withColumn("given", F.lit(True)).alias("n")
    joined = old.join(new, "user_id", "full_outer")
    cols = [
        F.when(F.col("given"), F.col(f"n.{c}") if c in changed or now is None else F.lit(now))
        .otherwise(F.col(f"o.{c}")).alias(c) if c in (*changed, "updated_at")
        else F.when(F.col("known"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        for c in profile.columns if c != "user_id"
    ]
    return joined.select("user_id", *cols)


def insert_missing(rows: DataFrame, new: DataFrame, keys: list[str], newest=()) -> DataFrame:
    """Append rows whose natural key is not stored yet, so that a rerun adds nothing.

    Of several new rows of a key the last by the ``newest`` columns is taken, then by
    its values. Null keys are keys like others.
    """
    given = one_per_key(new.select(*rows.columns), keys, newest=newest)
    stored = rows.select(*[F.col(k).alias(f"stored_{k}") for k in keys]).distinct()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"stored_{k}")) for k in keys])
    return rows.unionByName(given.join(stored, same, "left_anti"))


def replace_history(stored: DataFrame, history: DataFrame) -> DataFrame:
    """Drop everything of the users in ``history`` and put their given rows in place.

    For a stored log ``FlatLog.replace_users`` does this as one commit.
    """
    users = history.select("user_id").distinct()
    return stored.join(users, "user_id", "left_anti").unionByName(history.select(*stored.columns))


def baseline_sets(t, rows: list[tuple], users=None) -> DataFrame:
    """One baseline workout per user holding the literal sets (slug, set_number, weight, reps).

    The literal rows ride in the plan and are exploded per user.
    """
    literal = F.array(*[
        F.struct(F.lit(slug).alias("slug"), F.lit(n).alias("set_number"),
                 F.lit(str(weight)).cast("decimal(6,2)").alias("weight_kg"), F.lit(reps).alias("reps"))
        for slug, n, weight, reps in rows
    ])
    return (
        for_users(t["profile"], users)
        .select("user_id", F.inline(literal))
        .join(t["exercises"].select("exercise_id", "slug"), "slug")
        .select(F.concat(F.lit("baseline|"), F.col("user_id").cast("string")).alias("workout_key"), "user_id",
                "exercise_id", "set_number", F.col("weight_kg").cast("double").alias("weight_kg"), "reps")
    )


_USER_TABLES = ["goals", "injuries", "exercise_bans", "training_split", "user_exercises", "workouts"]


def cascade_delete(t, deleted: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting users: their rows go, the sets of their workouts go,
    and references to their plan rows are cleared."""
    gone = deleted.select("user_id").distinct()
    out = {"profile": t["profile"].join(gone, "user_id", "left_anti")}
    for name in _USER_TABLES:
        out[name] = t[name].join(gone, "user_id", "left_anti")
    out["workout_sets"] = t["workout_sets"].join(out["workouts"].select("workout_id"), "workout_id", "left_semi")
    kept_plans = out["training_split"].select(F.col("split_id").alias("kept_id")).distinct()
    out["user_exercises"] = (
        out["user_exercises"].join(kept_plans, F.col("split_id") == F.col("kept_id"), "left")
        .withColumn("split_id", F.col("kept_id")).drop("kept_id")
    )
    return out


def write_log(t, path: str, users=None) -> FlatLog:
    """Flat set log, partitioned by month and sorted by user, which the log operators read without a join."""
    log = FlatLog(t["workout_sets"].sparkSession, path)
    log.write(flat_rows(t, users))
    return log
