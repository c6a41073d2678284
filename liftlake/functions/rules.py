"""Scalar rules of the training log as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
MUSCLE_LABELS = {
    "chest": "Грудь",
    "back": "Спина",
    "biceps": "Бицепс",
    "triceps": "Трицепс",
    "shoulders": "Плечи",
    "legs": "Ноги",
}
MUSCLE_ORDER = ["chest", "back", "biceps", "triceps", "shoulders", "legs"]
PICKER_ORDER = ["chest", "biceps", "back", "triceps", "shoulders", "legs"]

# Focus of a workout created for one muscle group: app rule and chat rule.
FOCUS_APP = {"chest": "Chest + Biceps", "back": "Back + Triceps", "legs": "Legs"}
FOCUS_CHAT = {
    "chest": "Chest",
    "back": "Back",
    "biceps": "Biceps",
    "triceps": "Triceps",
    "shoulders": "Shoulders",
    "legs": "Legs",
}
FOCUS_UNKNOWN = "Logged"

# Muscles trained on a planned focus; any other focus means all of them.
PLAN_MUSCLES = {
    "Chest + Biceps": ["chest", "biceps"],
    "Back + Triceps": ["back", "triceps"],
    "Shoulders (+ legs sometimes)": ["shoulders", "legs"],
}

KG_LABEL = " кг × "
TIMES = " × "
SESSION_FORMS = ("тренировка", "тренировки", "тренировок")
IN_HISTORY = " в истории"
NOT_IN_HISTORY = "Не в истории"
# ----------------------------------------------------------------------------


def case_of(col: Column, mapping: dict, default) -> Column:
    """CASE col WHEN key THEN value; dictionary order is branch order."""
    default = default if isinstance(default, Column) else F.lit(default)
    expr = None
    for key, value in mapping.items():
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(col == key, value) if expr is None else expr.when(col == key, value)
    return expr.otherwise(default)


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def split_focus(muscle: Column, rule: str = "app") -> Column:
    """Focus a log entry belongs to, from the muscle group of its exercise."""
    return case_of(muscle, FOCUS_APP if rule == "app" else FOCUS_CHAT, FOCUS_UNKNOWN)


def plan_muscles(focus: Column) -> Column:
    mapping = {k: string_array(v) for k, v in PLAN_MUSCLES.items()}
    return case_of(focus, mapping, string_array(MUSCLE_ORDER))


def day_label(day: Column) -> Column:
    """Two-day label of the plan; Sunday counts with Friday and Saturday."""
    weekday = F.weekday(day)  # Monday = 0
    return F.when(weekday < 2, "Mon/Tue").when(weekday < 4, "Wed/Thu").otherwise("Fri/Sat")


def date_label(day: Column) -> Column:
    return F.date_format(day, "dd.MM")


def session_label(count: Column) -> Column:
    """Count with the Russian plural form of 'training session'."""
    one, few, many = SESSION_FORMS
    last, last_two = count % 10, count % 100
    word = (
        F.when((last == 1) & (last_two != 11), one)
        .when(last.between(2, 4) & ~last_two.between(10, 19), few)
        .otherwise(many)
    )
    return F.concat_ws(" ", count.cast("string"), word)


def _stripped(text: Column) -> Column:
    """Decimal text of a number text without trailing zeros; null beyond 26 digits."""
    return F.regexp_replace(text.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")


def plain_number(value: Column) -> Column:
    """Shortest decimal text, as the app writes it: 66, 32.5. Huge values keep their exponent."""
    text = value.cast("string")
    # A whole number of 32 bits is as it should be.
    return F.when(text.try_cast("int").cast("string") == text, text).otherwise(F.coalesce(_stripped(text), text))


def general_number(value: Column) -> Column:
    """Text with six significant digits, as the chat writes it: 66, 12.3457, 1e+15."""
    shortest = value.cast("double").cast("string")
    # Up to six digits before and after the point are all significant, and written without exponent from one on.
    short = value.between(1, 99_999) & (F.length(shortest) <= 7)
    science = F.format_string("%.5e", value.cast("double"))
    mantissa, exponent = F.substring_index(science, "e", 1), F.substring_index(science, "e", -1)
    plain = exponent.try_cast("int").between(-4, 5)
    return F.when(short, F.when(F.endswith(shortest, F.lit(".0")), F.substring_index(shortest, ".", 1)).otherwise(shortest)) \
        .when(value == 0, "0").when(plain, _stripped(science)).otherwise(
        F.concat(_stripped(mantissa), F.lit("e"), exponent))


def float_number(value: Column) -> Column:
    """Floating-point text: 66.0, 32.5."""
    return value.cast("double").cast("string")


def loaded_label(weight: Column, reps: Column, sets: Column, number=plain_number) -> Column:
    return F.concat(number(weight), F.lit(KG_LABEL), plain_number(reps), F.lit(TIMES), plain_number(sets))


def bodyweight_label(weight: Column, reps: Column, sets: Column) -> Column:
    unloaded = F.concat(plain_number(reps), F.lit(TIMES), plain_number(sets))
    return F.when(weight > 0, F.concat(F.lit("+"), loaded_label(weight, reps, sets))).otherwise(unloaded)


def set_label(is_bodyweight: Column, weight: Column, reps: Column, sets: Column) -> Column:
    return F.when(is_bodyweight, bodyweight_label(weight, reps, sets)).otherwise(loaded_label(weight, reps, sets))


def session_point_label(is_bodyweight: Column, weight: Column, reps: Column, sets: Column) -> Column:
    """Label of a chart point: a loaded bodyweight point carries no plus sign."""
    unloaded = is_bodyweight & (weight == 0)
    return F.when(unloaded, bodyweight_label(F.lit(0), reps, sets)).otherwise(loaded_label(weight, reps, sets))


def is_bodyweight(equipment: Column) -> Column:
    return F.coalesce(equipment == "bodyweight", F.lit(False))


def muscle_label(muscle: Column) -> Column:
    return case_of(muscle, MUSCLE_LABELS, muscle)


def display_position(muscle: Column, order: list[str]) -> Column:
    """Position in a fixed display order; unknown groups come after it."""
    known = F.array_position(string_array(order), muscle).cast("int")
    return F.when(known > 0, known).otherwise(len(order) + 1)


NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(text: Column) -> Column:
    """Number text with a dot, or null."""
    return F.when(F.trim(text).rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def parse_decimal(text: Column) -> Column:
    """Number typed with a comma or a dot; only the first comma counts as one."""
    trimmed = F.trim(text)
    comma = F.locate(",", trimmed)
    dotted = F.when(comma > 0, F.overlay(trimmed, F.lit("."), comma)).otherwise(trimmed)
    return parse_number(dotted)


def parse_log_weight(text: Column, bodyweight: Column) -> Column:
    """Weight of a form entry, null when it cannot be saved."""
    n = parse_decimal(text)
    own = F.when(F.trim(text) == "", 0.0).when(n >= 0, n)
    return F.when(bodyweight, own).otherwise(F.when(n > 0, n))


def entry_preview(weight_text: Column, reps_text: Column, sets_text: Column, bodyweight: Column) -> Column:
    """Label of a form entry that may be saved, else null.

    An empty number field counts as 0, and an unreadable bodyweight load too.
    """
    empty_is_zero = lambda text, n: F.when(F.trim(text) == "", 0.0).otherwise(n)
    weight = empty_is_zero(weight_text, parse_decimal(weight_text))
    reps = empty_is_zero(reps_text, parse_number(reps_text))
    sets = empty_is_zero(sets_text, parse_number(sets_text))
    counts_ok = (reps > 0) & (sets > 0)
    return F.when(
        counts_ok & bodyweight, bodyweight_label(F.coalesce(weight, F.lit(0.0)), reps, sets)
    ).when(counts_ok & (weight > 0), loaded_label(weight, reps, sets))


def picker_subtitle(logged: Column, bodyweight: Column, weight, reps, sets, sessions: Column) -> Column:
    zero = F.lit(0)
    today = set_label(bodyweight, F.coalesce(weight, zero), F.coalesce(reps, zero), F.coalesce(sets, zero))
    return F.when(logged, today).when(
        sessions > 0, F.concat(sessions.cast("string"), F.lit(IN_HISTORY))
    ).otherwise(NOT_IN_HISTORY)


def summary_title(day: Column, focus: Column) -> Column:
    return F.concat_ws(" · ", date_label(day), F.nullif(focus, F.lit("")))


def local_date(ts: Column, tz: Column) -> Column:
    """Calendar date at the user's place of a UTC time."""
    return F.from_utc_timestamp(ts.cast("timestamp"), tz).cast("date")


def json_text(m: Column) -> Column:
    """Map as one-line JSON with ', ' and ': ' between the parts."""
    entries = F.transform(
        F.map_entries(m),
        lambda e: F.concat(_json_value(e["key"]), F.lit(": "), _json_value(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def _json_value(c: Column) -> Column:
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
