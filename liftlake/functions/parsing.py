"""Chat message parsing as column expressions, without Python per row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
PROGRAM_HINTS = [
    "программ", "пропиши", "план трен", "что делать", "что мне делать",
    "с чего начать", "напиши трен", "составь", "подскажи упражн",
]
LOG_HINTS = [
    "сделал", "сделала", "отработал", "записал", "потренировал",
    "прошел", "прошёл", "сегодня жим", "сегодня сделал",
]
TODAY_WORDS = ["сегодня", "today"]
YESTERDAY_WORDS = ["вчера", "yesterday"]
DEFAULT_SETS = 3
LARGEST_COUNT = 2_147_483_647

# weight, reps and optional sets joined by a separator: "66 кг на 7 повторов на 3 подхода"
WEIGHT_SETS = (
    r"(?iuU)(\d+(?:[.,]\d+)?)\s*(?:кг|kg)?\s*"
    r"(?:на|x|х|×|\*|/)\s*"
    r"(\d+)\s*"
    r"(?:повтор\w*|rep\w*|раз\w*)?\s*"
    r"(?:(?:на|x|х|×|\*|/)\s*)?"
    r"(\d+)?\s*"
    r"(?:подход\w*|сет\w*|set\w*)?"
)
# three numbers separated by blanks: "66 7 3"
SPACE_TRIPLE = r"(?U)(\d+(?:[.,]\d+)?)\s+(\d+)\s+(\d+)"
# day and month with an optional year: "07.06", "7/6/26"
DAY_MONTH = r"(?U)\b(\d{1,2})[./](\d{1,2})(?:[./](\d{2,4}))?\b"
# ----------------------------------------------------------------------------

# Parts the groups of a match in a replaced text.
_CUT, _NO_CUT = "\x01", "\x02"
SPANS = "array<struct<neg_size:int,ord:int,pos:int,lo:int,hi:int,slug:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the words occurs. The text is read once a word, so it should be a column or bound by ``let``."""
    return reduce(or_, [text.contains(word) for word in words])


def _groups(text: Column, pattern: str) -> Column:
    """The three groups of the first match as an array of texts, without a match one text alone.

    One replacement of the whole text by the groups of its first match, so the text
    is searched once; a digit inside a word ("reps5") is not taken for a number.
    """
    # The other sign is as little a part of the patterns.
    plain = F.when(text.contains(_CUT), F.translate(text, _CUT, _NO_CUT)).otherwise(text)
    return F.split(F.regexp_replace(plain, f"(?s)^.*?{pattern}.*$", f"$1{_CUT}$2{_CUT}$3"), _CUT)


def _positive(groups: Column) -> Column:
    """Struct of the numbers in three texts, null unless all are positive. Counts beyond a 32-bit integer become the largest one."""
    large = lambda c: F.least(c.try_cast("decimal(38,0)"), F.lit(LARGEST_COUNT).cast("decimal(38,0)")).cast("int")
    # Counts beyond 32 bits, and digits of other scripts, take the longer way.
    count = lambda c: F.coalesce(c.try_cast("int"), large(c))
    digits = lambda c: F.when(F.length(c) <= 30, c).otherwise(F.lit(str(LARGEST_COUNT)))
    found = F.struct(
        F.replace(F.get(groups, F.lit(0)), F.lit(","), F.lit(".")).try_cast("double").alias("weight_kg"),
        count(digits(F.get(groups, F.lit(1)))).alias("reps"),
        count(digits(F.coalesce(F.nullif(F.get(groups, F.lit(2)), F.lit("")), F.lit(str(DEFAULT_SETS))))).alias("sets"),
    )
    return F.when(F.size(groups) == 3, let(found, lambda n: F.when(
        (n["weight_kg"] > 0) & (n["reps"] > 0) & (n["sets"] > 0), n)))


def parse_numbers(text: Column) -> Column:
    """Struct (weight_kg, reps, sets), null when neither notation gives positive numbers."""
    return let(text, lambda text: F.coalesce(
        let(_groups(text, WEIGHT_SETS), _positive), let(_groups(text, SPACE_TRIPLE), _positive)))


def parse_date(text: Column, today: Column) -> Column:
    """Day the message speaks of; ``today`` when it names none or an impossible one."""
    found = F.regexp_extract(text, DAY_MONTH, 0)
    day = lambda found: F.when(found != "", let(F.split(found, "[./]"), lambda p: _calendar_day(p, today)))
    return let(normalized(text), lambda norm: (
        F.when(contains_any(norm, TODAY_WORDS), today)
        .when(contains_any(norm, YESTERDAY_WORDS), F.date_sub(today, 1))
        .otherwise(F.coalesce(let(found, day), today))
    ))


def _calendar_day(parts: Column, today: Column) -> Column:
    """Date from [day, month] or [day, month, year] texts, null when there is no such day."""
    year = F.get(parts, F.lit(2))
    full_year = (
        F.when(year.isNull(), F.year(today).cast("string"))
        .when(F.length(year) == 2, F.concat(F.lit("20"), year))
        .otherwise(F.nullif(F.lpad(year, 4, "0"), F.lit("0000")))
    )
    two = lambda i: F.lpad(F.get(parts, F.lit(i)), 2, "0")
    return F.concat(full_year, F.lit("-"), two(1), F.lit("-"), two(0)).try_cast("date")


def is_workout_log(text: Column, has_exercise: Column, has_numbers: Column) -> Column:
    """Does a message report a workout, given what was found in it?"""
    reports = let(normalized(text), lambda norm: contains_any(norm, LOG_HINTS) & ~contains_any(norm, PROGRAM_HINTS))
    return has_exercise & (has_numbers | reports)


def _pieces(norm: Column, matcher) -> Column:
    """A normalised text cut before every place where an alias begins, with a mark behind the longest one there."""
    open_, close, other = matcher.marks
    marked = norm.contains(open_) | norm.contains(close)
    plain = F.when(marked, F.translate(norm, open_ + close, other * 2)).otherwise(norm)
    return F.split(F.regexp_replace(plain, f"(?=({matcher.pattern}))", f"{open_}$1{close}"), open_)


def _begun(alias: Column, matcher, entries: Column) -> Column:
    """What an alias begins with. The bucket is found by its number, so the time does not grow with the dictionary."""
    return F.element_at(F.get(entries, F.pmod(F.xxhash64(alias), F.lit(matcher.buckets)).cast("int")), alias)


def _spans(pieces: Column, matcher, entries: Column) -> Column:
    """Every occurrence of an alias in a text's pieces, overlapping ones included.

    The shorter aliases beginning at a place are those the longest begins with (``entries``).
    """
    close = matcher.marks[1]
    walk = F.aggregate(
        F.slice(pieces, 2, F.size(pieces) - 1),
        F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(SPANS).alias("found")),
        lambda acc, piece: let(F.split(piece, close), lambda part: F.struct(
            (acc["at"] + F.length(part[1])).alias("at"),
            F.concat(acc["found"], F.transform(_begun(part[0], matcher, entries), lambda e: F.struct(
                e["neg_size"].alias("neg_size"), e["ord"].alias("ord"), e["pos"].alias("pos"),
                acc["at"].alias("lo"), (acc["at"] + e["size"]).alias("hi"), e["slug"].alias("slug")))).alias("found"),
        )),
    )
    return F.sort_array(walk["found"])


def accepted_slugs(spans: Column) -> Column:
    """Distinct slugs of the spans in order, leaving out spans that overlap one accepted before."""
    accepted = F.aggregate(
        spans,
        F.array().cast("array<struct<lo:int,hi:int,slug:string>>"),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: (s["lo"] < k["hi"]) & (k["lo"] < s["hi"])), kept
        ).otherwise(F.array_append(kept, F.struct(
            s["lo"].alias("lo"), s["hi"].alias("hi"), s["slug"].alias("slug")))),
    )
    return F.array_distinct(F.transform(accepted, lambda s: s["slug"]))


def resolve_slugs(text: Column, matcher, entries: Column) -> Column:
    """Distinct slugs named in a text: longest aliases first, ties in catalog order, then from left to right.

    Aliases that begin at one place overlap, so a text with one such place names the first of them. No text names none.
    """
    first = lambda pieces: F.get(_begun(F.substring_index(F.get(pieces, F.lit(1)), matcher.marks[1], 1), matcher, entries), F.lit(0))
    return let(let(F.trim(normalized(text)), lambda norm: _pieces(norm, matcher)), lambda pieces: (
        F.when(F.size(pieces) == 2, F.array(first(pieces)["slug"]))
        .when(F.size(pieces) > 2, accepted_slugs(_spans(pieces, matcher, entries)))
        .otherwise(F.array().cast("array<string>"))))
