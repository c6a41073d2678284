"""Per-user history reports and the context added to a chat message.

The texts are assembled per section with one aggregation each. Sections built
from workouts cover the history window, which bounds a user's document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.functions import parsing, rules
from liftlake.operators.common import for_users
from liftlake.operators.history import exercise_progress, focus_counts, history_window
from liftlake.operators.messages import each_slug, with_slugs
from liftlake.operators.sessions import user_exercises
from liftlake.session import stored

# --- Fixed values: report texts ---------------------------------------------
ALIASES_SHOWN = 6
ALIAS_HEADER = (
    "## Exercise name aliases (user chat → database)\n"
    "When the user names an exercise informally, map it to the canonical name and slug below.\n"
)
MATCH_HEADER = "## Exercises detected in user message"
MATCH_FOOTER = "Use progression data for these slugs below. Do not say the exercise is missing from the log."
FOCUSED_HEADER = "## Focused exercise history (matched from user message)"
PROFILE_HEADER = "## Profile"
CONTEXT_HEADER = "[Fresh data — use for this reply]"
SECTION_SPLIT = "\n## Training split (plan)"
SECTION_GOALS = "\n## Active goals"
SECTION_INJURIES = "\n## Injuries / limitations"
SECTION_BANS = "\n## Banned exercises"
SECTION_COUNTS = "\n## Workout session counts (full log)"
SECTION_PROGRESSION = "\n## Key lift progression (every logged session)"
SECTION_LOG = "\n## Full workout log (all sessions, chronological)"
CHEST_LINE = "- Chest-related sessions (Chest / Chest + Biceps): **"
NO_SETS = "- (no sets logged)"
DASH = "—"
DEFAULT_BAN_REASON = "banned"
# Upper end of the rep range by role.
REP_CEILING = {"base": 8, "accessory": 10}
# ----------------------------------------------------------------------------


def active_goals(t, users=None) -> DataFrame:
    return for_users(t["goals"], users).where("status = 'active'").select(
        "user_id", "horizon", "description", "sort_order")


def current_injuries(t, users=None) -> DataFrame:
    return for_users(t["injuries"], users).where(F.col("status").isin("active", "recovering")).select(
        "user_id", "injury_id", "body_part", "status", F.coalesce(F.nullif("notes", F.lit("")), F.lit(DASH)).alias("notes"))


def active_bans(t, users=None) -> DataFrame:
    return for_users(t["exercise_bans"], users).where("is_active").select(
        "user_id", "ban_id", "exercise_name",
        F.coalesce(F.nullif("reason", F.lit("")), F.lit(DEFAULT_BAN_REASON)).alias("reason"))


def active_split(t, users=None) -> DataFrame:
    return for_users(t["training_split"], users).where("is_active").select(
        "user_id", "day_label", "focus", "sort_order")


def _lines(*order: Column, line: Column) -> Column:
    """Aggregate: the lines of a group in order, joined by newlines."""
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], line.alias("line"))
    return F.array_join(F.sort_array(F.collect_list(keyed))["line"], "\n")


def _section(title: str, body: Column) -> Column:
    """Title and body, null when there is no body."""
    return F.concat(F.lit(title + "\n"), body)


def set_detail(t) -> DataFrame:
    """Text of the sets per (workout, exercise), collapsed when all are equal."""
    return _set_texts(t["workout_sets"], ["workout_id", "exercise_id"])


def _set_texts(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Equal sets are counted first, so a group holds its distinct (weight, reps) only."""
    distinct = sets.groupBy(*keys, "weight_kg", "reps").agg(F.count(F.lit(1)).cast("int").alias("n"))
    sorted_sets = distinct.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("weight_kg", "reps", "n"))).alias("s"))
    weight = lambda x: rules.float_number(x["weight_kg"])
    listed = F.flatten(F.transform("s", lambda x: F.array_repeat(
        F.concat(weight(x), F.lit("×"), x["reps"].cast("string")), x["n"])))
    one = F.get("s", F.lit(0))
    equal = F.concat(weight(one), F.lit(" kg × "), one["reps"].cast("string"), F.lit(" × "), one["n"].cast("string"))
    return sorted_sets.select(
        *keys, (F.size("s") == 1).alias("uniform"),
        F.when(F.size("s") == 1, equal).otherwise(F.array_join(listed, ", ")).alias("detail"))


def uniform_sets(t) -> DataFrame:
    """Are all sets of a (workout, exercise) equal?"""
    pair = F.struct("weight_kg", "reps")
    return t["workout_sets"].groupBy("workout_id", "exercise_id").agg(
        (F.min(pair) == F.max(pair)).alias("uniform"), F.count(F.lit(1)).alias("sets_count"))


def log_state(t, users=None) -> DataFrame:
    """The history window with the set texts of its workouts, stored once for all sections of a report.

    One row per workout with its exercises in catalog order; one scan of workouts
    and one of sets, whose rows meet by workout and stay there until the row is whole.
    """
    window = history_window(t, users).drop("created_at")
    keys = window.columns
    # A workout without sets has one row without exercise.
    sets = window.join(t["workout_sets"].select("workout_id", "exercise_id", "weight_kg", "reps"), "workout_id", "left")
    e = t["exercises"].select("exercise_id", "slug", "name", "ord")
    texts = _set_texts(sets, [*keys, "exercise_id"]).join(e, "exercise_id", "left")
    known = F.when(F.col("slug").isNotNull(), F.struct("ord", "slug", "name", "detail"))
    return stored(texts.groupBy(*keys).agg(F.sort_array(F.collect_list(known)).alias("exercises")), "log-state")


def key_lift_progression(t, users=None, state: DataFrame | None = None) -> DataFrame:
    """Block of lines per (user, exercise) of the history window, in chronological order.

    Label, order and membership are those of the alias catalog: an exercise outside
    it has no block.
    """
    state = log_state(t, users) if state is None else state
    catalog = t["catalog_source"].select("slug", F.col("canonical").alias("label"), F.col("ord").alias("place"))
    line = F.concat(F.lit("  - "), F.col("workout_date").cast("string"), F.lit(" ("),
                    F.coalesce("split_focus", F.lit("")), F.lit("): "), F.col("detail"))
    lines = state.select("user_id", "position", "workout_date", "split_focus", F.inline("exercises"))
    blocks = lines.groupBy("user_id", "slug").agg(
        _lines(F.col("position"), line=line).alias("body"), F.count(F.lit(1)).alias("sessions"))
    return blocks.join(catalog, "slug").select(
        "user_id", "slug", F.col("place").alias("ord"), "sessions",
        F.concat(F.lit("**"), F.col("label"), F.lit(":**\n"), F.col("body"), F.lit("\n")).alias("block"))


def full_log(t, users=None, state: DataFrame | None = None) -> DataFrame:
    """Block per workout of the history window: header and one line per exercise."""
    state = log_state(t, users) if state is None else state
    body = F.array_join(F.transform("exercises", lambda e: F.concat(F.lit("- "), e["name"], F.lit(": "), e["detail"])), "\n")
    focus = F.nullif("split_focus", F.lit(""))
    header = F.concat(F.lit("### "), F.col("workout_date").cast("string"),
                      F.coalesce(F.concat(F.lit(" ("), focus, F.lit(")")), F.lit("")))
    return state.select(
        "user_id", "workout_id", "position",
        F.concat(header, F.lit("\n"), F.when(F.size("exercises") > 0, body).otherwise(NO_SETS), F.lit("\n")).alias("block"))


def alias_reference(t) -> DataFrame:
    """Line per exercise with its first aliases as written and the number of further ones."""
    shown = F.array_join(F.transform(F.slice("aliases", 1, ALIASES_SHOWN),
                                     lambda a: F.concat(F.lit("«"), a, F.lit("»"))), ", ")
    more = F.size("aliases") - ALIASES_SHOWN
    rest = F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")
    return t["catalog_source"].select(
        "slug", "ord",
        F.concat(F.lit("- **"), F.col("canonical"), F.lit("** (`"), F.col("slug"), F.lit("`): "), shown, rest).alias("line"))


def _alias_text(t) -> Column:
    """The whole alias reference as a scalar; the catalog is the same for every user."""
    return alias_reference(t).agg(
        F.concat(F.lit("\n" + ALIAS_HEADER + "\n"), _lines(F.col("ord"), line=F.col("line"))).alias("text")).scalar()


def _lifts(t, state: DataFrame) -> DataFrame:
    """Per user, the progressions of the history window in catalog order."""
    lift = F.struct(F.col("ord").alias("place"), "block", "slug")
    return key_lift_progression(t, state=state).groupBy("user_id").agg(F.sort_array(F.collect_list(lift)).alias("lifts"))


def profile_sections(t, users=None, state: DataFrame | None = None, lifts: DataFrame | None = None) -> DataFrame:
    """Profile columns with one text column per section; an empty section is null."""
    state = log_state(t, users) if state is None else state
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    counts = focus_counts(t, users, window=state).groupBy("user_id").agg(
        F.sum("workouts").alias("total"), F.max("chest_related").alias("chest"),
        _lines(F.col("position"), line=F.concat(
            F.lit("- "), F.col("focus"), F.lit(": "), F.col("workouts").cast("string"))).alias("focus_lines"))
    split = active_split(t, users).groupBy("user_id").agg(_section(SECTION_SPLIT, _lines(
        F.col("sort_order"), line=F.concat(F.lit("- "), F.col("day_label"), F.lit(": "), F.col("focus")))).alias("split"))
    goals = active_goals(t, users).groupBy("user_id").agg(_section(SECTION_GOALS, _lines(
        F.col("horizon"), F.col("sort_order"),
        line=F.concat(F.lit("- ["), F.col("horizon"), F.lit("] "), F.col("description")))).alias("goals"))
    injuries = current_injuries(t, users).groupBy("user_id").agg(_section(SECTION_INJURIES, _lines(
        F.col("injury_id"), line=F.concat(
            F.lit("- "), F.col("body_part"), F.lit(" ("), F.col("status"), F.lit("): "), F.col("notes")))).alias("injuries"))
    bans = active_bans(t, users).groupBy("user_id").agg(_section(SECTION_BANS, _lines(
        F.col("ban_id"), line=F.concat(
            F.lit("- "), F.col("exercise_name"), F.lit(" — "), F.col("reason")))).alias("bans"))
    log = full_log(t, users, state).groupBy("user_id").agg(
        _section(SECTION_LOG, _lines(F.col("position"), line=F.col("block"))).alias("log"))

    rows = for_users(t["profile"], users)
    for part in (counts, split, goals, injuries, bans, _lifts(t, state) if lifts is None else lifts, log):
        rows = rows.join(part, "user_id", "left")
    total = F.coalesce("total", F.lit(0))
    nutrition = F.when(F.size("nutrition") > 0, F.concat(F.lit("- Nutrition: "), rules.json_text(F.col("nutrition"))))
    profile = F.concat_ws(
        "\n",
        F.lit(PROFILE_HEADER),
        F.concat(F.lit("- Name: "), text(F.col("display_name"))),
        F.concat(F.lit("- Weight: "), text(F.col("weight_kg").cast("double")), F.lit(" kg, height: "),
                 text(F.col("height_cm"))),
        F.concat(F.lit("- Body type: "), text(F.col("body_type")), F.lit(", goal: "), text(F.col("goal"))),
        F.concat(F.lit("- Notes: "), F.coalesce(F.nullif("notes", F.lit("")), F.lit(DASH))),
        F.concat(F.lit("- Total logged workouts: "), total.cast("string")),
        nutrition,
    )
    session_counts = F.concat_ws("\n", F.concat(
        F.lit(SECTION_COUNTS + "\n" + CHEST_LINE), F.coalesce("chest", F.lit(0)).cast("string"), F.lit("**")), "focus_lines")
    return rows.select(
        "user_id", total.cast("bigint").alias("logged_workouts"),
        F.when(F.col("lifts").isNull(), 0).otherwise(F.size("lifts")).cast("bigint").alias("n_lifts"),
        profile.alias("profile"), "split", "goals", "injuries", "bans", session_counts.alias("session_counts"),
        _section(SECTION_PROGRESSION, F.array_join(F.col("lifts")["block"], "\n")).alias("progression"),
        "log")


def profile_snapshot(t, users=None, state: DataFrame | None = None, lifts: DataFrame | None = None) -> DataFrame:
    """One document per registered user; empty sections are left out."""
    s = profile_sections(t, users, state, lifts)
    return s.select(
        "user_id", "logged_workouts", "n_lifts",
        F.concat_ws("\n", "profile", "split", "goals", "injuries", "bans", "session_counts",
                    _alias_text(t), "progression", "log").alias("document"))


def _with_names(t, rows: DataFrame) -> DataFrame:
    """Rows with the catalog's names as one map; the catalog is a dimension of bounded size."""
    names = t["catalog_source"].agg(F.map_from_entries(F.collect_list(F.struct("slug", "canonical")))).scalar()
    return rows.withColumn("names", names)


def _only(slugs: Column) -> Column:
    return F.get(slugs, F.lit(0))


def _match_text(slugs: Column, names: Column) -> Column:
    """What a message names, as lines for the reader; null when it names nothing. One name, the usual case, needs no list."""
    line = lambda slug: F.concat(
        F.lit("- User likely means: **"), F.element_at(names, slug), F.lit("** (slug: `"), slug, F.lit("`)"))
    lines = F.when(F.size(slugs) == 1, F.coalesce(line(_only(slugs)), F.lit(""))).otherwise(
        F.array_join(F.transform(slugs, line), "\n"))
    return F.when(F.size(slugs) > 0, F.concat(F.lit(MATCH_HEADER + "\n"), lines, F.lit("\n\n" + MATCH_FOOTER)))


def matched_lines(t, messages: DataFrame) -> DataFrame:
    """What each message names; messages naming nothing give no row."""
    # Expanding an array of zero or one texts keeps the matching from being done again in a filter.
    text = _match_text(F.col("slugs"), F.col("names"))
    found = _with_names(t, with_slugs(t, messages))
    return found.select("msg_id", F.explode(F.filter(F.array(text), lambda x: x.isNotNull())).alias("text"))


def _resolved(t, messages: DataFrame) -> DataFrame:
    """Messages with the exercises they name, stored: their users are asked for before their texts."""
    return stored(with_slugs(t, messages.select("msg_id", "user_id", "text")), "messages")


def _blocks(lifts: DataFrame) -> DataFrame:
    """Per user, the progression of each exercise as a map."""
    return lifts.select("user_id", F.map_from_arrays(F.col("lifts")["slug"], F.col("lifts")["block"]).alias("blocks"))


def _focused(slugs: Column, blocks: Column) -> Column:
    """Progressions of the named exercises; null without any."""
    held = F.filter(F.transform(slugs, lambda slug: F.element_at(blocks, slug)), lambda b: b.isNotNull())
    header = F.lit(FOCUSED_HEADER + "\n")
    several = parsing.let(held, lambda held: F.when(F.size(held) > 0, F.concat(header, F.array_join(held, "\n"))))
    return F.when(F.size(slugs) == 1, F.concat(header, F.element_at(blocks, _only(slugs)))).otherwise(several)


def focused_progression(t, messages: DataFrame) -> DataFrame:
    """History of the exercises named in a message; no row without any history.

    Only the histories of users whose messages name an exercise are read.
    """
    found = _resolved(t, messages).where(F.size("slugs") > 0)
    blocks = _blocks(_lifts(t, log_state(t, found)))
    text = F.filter(F.array(_focused(F.col("slugs"), F.col("blocks"))), lambda x: x.isNotNull())
    return found.join(blocks, "user_id").select("msg_id", F.explode(text).alias("text"))


def message_context(t, messages: DataFrame) -> DataFrame:
    """Message with everything known about its user and the exercises it names, and the number of its characters.

    The text stays as it is when nothing applies. Histories of the users who wrote
    are read once. A message meets its user's progressions first and leaves with the
    few lines that it names; only then it meets the document, which goes from there
    into its text without being copied into a row.
    """
    found = _resolved(t, messages)
    writers = stored(found.select("user_id").distinct(), "writers")
    state = log_state(t, writers)
    lifts = stored(_lifts(t, state), "lifts")
    split, closing = "\n\n", "\n\n---\nUser: "
    # A document's end and its number of characters are made once per user, before it meets the messages.
    end = F.concat(F.col("document"), F.lit(closing))
    ends = profile_snapshot(t, writers, state, lifts).select("user_id", end.alias("end"), F.length(end).alias("end_chars"))
    found = _with_names(t, found.join(_blocks(lifts), "user_id", "left")).select(
        "msg_id", "user_id", "text", _match_text(F.col("slugs"), F.col("names")).alias("matched"),
        _focused(F.col("slugs"), F.col("blocks")).alias("focused"))
    rows = found.select(
        "msg_id", "user_id", "text", F.coalesce("matched", "focused").isNotNull().alias("named"),
        F.concat(F.lit(CONTEXT_HEADER + "\n"), F.concat_ws(split, "matched", "focused")).alias("head")).join(ends, "user_id", "left")
    # No function on arrays or maps from here on: it would have the joined rows written out, documents included, before it is applied.
    named, known = F.col("named"), F.col("end").isNotNull()
    between = F.when(named & known, F.lit(split)).otherwise(F.lit(""))
    context = F.concat("head", between, F.coalesce("end", F.lit(closing)), "text")
    n_chars = F.length("head") + F.length(between) + F.coalesce("end_chars", F.lit(len(closing))) + F.length("text")
    return rows.select(
        "msg_id", F.when(named | known, context).otherwise(F.col("text")).alias("context"),
        F.when(named | known, n_chars).otherwise(F.length("text")).alias("n_chars"))


def allowed_catalog(t, users=None) -> DataFrame:
    """Catalog per registered user without the exercises of active bans.

    Bans are free text and go through the alias matching of chat messages.
    """
    bans = active_bans(t, users).select("user_id", F.col("ban_id").alias("msg_id"), F.col("exercise_name").alias("text"))
    banned = each_slug(t, bans, "user_id").select("user_id", "slug").distinct()
    return (
        user_exercises(t, users)
        .join(banned, ["user_id", "slug"], "left_anti")
        .select("user_id", "muscle_group", "slug", "name")
    )


def next_load(t, users=None) -> DataFrame:
    """Next target from the latest top set: a kilogram more at the end of the rep range, else one rep."""
    last = exercise_progress(t, users).groupBy("user_id", "slug").agg(
        F.max_by(F.struct("max_weight", "reps", "sets_count"), "workout_date").alias("last"))
    roles = t["user_exercises"].join(t["exercises"].select("exercise_id", "slug"), "exercise_id").select(
        "user_id", "slug", "role")
    ceiling = rules.case_of(F.col("role"), REP_CEILING, REP_CEILING["base"])
    full = F.col("last.reps") >= ceiling
    return last.join(roles, ["user_id", "slug"], "left").select(
        "user_id", "slug",
        (F.col("last.max_weight") + F.when(full, 1.0).otherwise(0.0)).alias("next_weight_kg"),
        (F.col("last.reps") + F.when(full, 0).otherwise(1)).alias("next_reps"),
        F.col("last.sets_count").alias("next_sets"))


def allowed_users(rows: DataFrame, config) -> DataFrame:
    """Rows of the users listed in a comma-separated configuration.

    ``config`` is a string, or a frame of such strings in column ``ids``; blanks
    are skipped and an empty list is an error in either form.
    """
    if isinstance(config, str):
        ids = [int(p) for p in (p.strip() for p in config.split(",")) if p]
        if not ids:
            raise ValueError("the list of allowed users names no user id")
        return rows.where(F.col("user_id").isin(ids))
    ids = (
        config.select(F.explode(F.split("ids", ",")).alias("id"))
        .select(F.trim("id").alias("id")).where("id <> ''")
        .select(F.col("id").cast("bigint").alias("user_id")).distinct()
    )
    if ids.isEmpty():
        raise ValueError("the list of allowed users names no user id")
    return rows.join(ids, "user_id", "left_semi")


def profile_or_fallback(users: DataFrame, profile: DataFrame, local: DataFrame) -> DataFrame:
    """Profile per user from the table, else from the local source, else marked missing."""
    cols = ["user_id", "display_name", "goal"]
    main = profile.select(*cols, F.lit("table").alias("source"))
    spare = local.select(*cols, F.lit("local").alias("source"))
    m, s = main.alias("m"), spare.alias("s")
    joined = users.select("user_id").distinct().join(m, "user_id", "left").join(s, "user_id", "left")
    pick = lambda c: F.when(F.col("m.source").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(f"s.{c}"))
    return joined.select("user_id", pick("display_name").alias("display_name"), pick("goal").alias("goal"),
                         F.coalesce("m.source", "s.source", F.lit("missing")).alias("source"))
