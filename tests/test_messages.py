"""Message parsing: fixed samples and a brute-force matcher."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from liftlake.functions import parsing, rules
from liftlake.operators import messages as m
from liftlake.sources import catalog

TODAY = dt.date(2026, 7, 10)


@pytest.mark.parametrize("text,expected", [
    ("жим 66×7×3", (66.0, 7, 3)), ("Жим 66 КГ НА 7 повторов на 3 подхода", (66.0, 7, 3)),
    ("66 на 6 три подхода", (66.0, 6, 3)), ("жим 25/06", (25.0, 6, 3)), ("33,5x8x3", (33.5, 8, 3)),
    ("12.5 на 10", (12.5, 10, 3)), ("66x12", (66.0, 12, 3)), ("66 7 3", (66.0, 7, 3)), ("0×10×3", None),
    ("66 на 7 3", (66.0, 7, 3)), ("62.5 на 8", (62.5, 8, 3)), ("07.07.26", None), ("", None),
    ("0x5 70 8 4", (5.0, 70, 8)), ("66 х 7 ПОВТОРЕНИЙ х 4 подхода", (66.0, 7, 4)), ("66*0", None),
    ("99999999999999x5", (99999999999999.0, 5, 3)),
    ("5x99999999999", (5.0, 2147483647, 3)),  # the largest count stands for larger ones, which cannot be stored
])
def test_numbers(spark, text, expected):
    got = spark.range(1).select(parsing.parse_numbers(F.lit(text)).alias("n")).first()["n"]
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize("text,expected", [
    ("сегодня жим 25/06", TODAY), ("вчера жим 66x7", dt.date(2026, 7, 9)), ("YESTERDAY", dt.date(2026, 7, 9)),
    ("жим 25/06", dt.date(2026, 6, 25)), ("12.5 на 10", dt.date(2026, 5, 12)), ("12.5×8×3", dt.date(2026, 5, 12)),
    ("12.5x8", TODAY), ("12.5кг", TODAY), ("62.5 на 8", TODAY), ("07.07.26", dt.date(2026, 7, 7)),
    ("7/6/2025", dt.date(2025, 6, 7)), ("31.02", TODAY), ("1.1.0000", TODAY), ("без даты", TODAY),
    ("29.02.24", dt.date(2024, 2, 29)), ("5.5.123", dt.date(123, 5, 5)),
])
def test_dates(spark, text, expected):
    got = spark.range(1).select(parsing.parse_date(F.lit(text), F.lit(TODAY)).alias("d")).first()["d"]
    assert got == expected


def dictionary(spark, entries):
    rows = [(slug, name, "chest", aliases, i) for i, (slug, (name, aliases)) in enumerate(entries.items())]
    return spark.createDataFrame(rows, catalog.CATALOG_SCHEMA)


def greedy(entries, text):
    """Longest alias first, ties by catalog order, then left to right; spans never overlap."""
    norm = text.lower().replace("ё", "е").strip()
    table = []
    for slug, (name, aliases) in entries.items():
        for alias in dict.fromkeys(a.lower().replace("ё", "е").strip() for a in [*aliases, name]):
            if alias:
                table.append((alias, slug))
    taken, out = [], []
    for alias, slug in sorted(table, key=lambda a: -len(a[0])):
        for lo in range(len(norm) - len(alias) + 1):
            hi = lo + len(alias)
            if norm[lo:hi] == alias and all(hi <= a or lo >= b for a, b in taken):
                taken.append((lo, hi))
                if slug not in out:
                    out.append(slug)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_equals_brute_force(spark, make, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abё ") for _ in range(n))
    entries = {f"s{i}": (word(rng.randint(1, 4)), [word(rng.randint(1, 5)) for _ in range(rng.randint(0, 4))])
               for i in range(15)}
    texts = [word(rng.randint(0, 14)) for _ in range(300)] + ["ababababab", "жим aaaa ЖИМ"]
    t = make(catalog_source=dictionary(spark, entries))
    msgs = spark.createDataFrame(list(enumerate(texts)), "msg_id bigint, text string")
    expected = [(i, greedy(entries, text)) for i, text in enumerate(texts)]
    small = {r["msg_id"]: r["slugs"] for r in m.with_slugs(t, msgs).collect()}
    large = {r["msg_id"]: r["slugs"] for r in m.with_slugs(t, msgs, limit=0).collect()}
    assert [(i, small[i]) for i in range(len(texts))] == expected
    assert [(i, large[i]) for i in range(len(texts))] == expected


def test_regex_signs_in_aliases_are_literal(spark, make):
    t = make(catalog_source=dictionary(spark, {"a": ("ez (x)", ["a.b", "c+"]), "b": ("[z]*", [])}))
    msgs = spark.createDataFrame([(1, "EZ (X) and axb"), (2, "a.b c+ [z]*"), (3, "cc")], "msg_id bigint, text string")
    got = {r["msg_id"]: r["slugs"] for r in m.with_slugs(t, msgs).collect()}
    assert got == {1: ["a"], 2: ["b", "a"], 3: []}


def test_large_catalog_takes_the_join(t):
    msgs = t["messages"]
    a, b = m.with_slugs(t, msgs), m.with_slugs(t, msgs, limit=10)
    assert rows(a, "msg_id", "slugs") == rows(b, "msg_id", "slugs")


def test_classification(spark, make):
    t = make(exercises=[(1, "bench", "Bench", "chest", "barbell"), (2, "dip", "Dip", "chest", "bodyweight")],
             catalog_source=dictionary(spark, {"bench": ("Bench", ["жим"]), "dip": ("Dip", [])}))
    texts = ["жим 66×7×3", "составь программу жим", "составь жим 66x7", "сделал жим", "жим", "66×7×3",
             "жим и dip 66×7×3", "  ", "сделал жим, составь программу", "прошёл жим"]
    msgs = spark.createDataFrame([(i, 1, TODAY, x) for i, x in enumerate(texts)],
                                 "msg_id bigint, user_id bigint, msg_date date, text string")
    got = {r["msg_id"]: (r["confidence"], r["weight_kg"], r["reps"], r["sets"]) for r in m.parsed_log(t, msgs).collect()}
    assert got == {0: ("high", 66.0, 7, 3), 2: ("high", 66.0, 7, 3), 3: ("medium", 0.0, 0, 0),
                   6: ("medium", 66.0, 7, 3), 9: ("medium", 0.0, 0, 0)}
    route = dict(rows(m.route_messages(t, msgs), "msg_id", "outcome"))
    assert [route[i] for i in range(10)] == ["saved", "pass_through", "saved", "clarify", "pass_through", "pass_through",
                                             "clarify", "pass_through", "pass_through", "clarify"]


def test_structured_payloads(spark, make):
    t = make(catalog_source=dictionary(spark, {"bench": ("Bench", [])}))
    entries = spark.createDataFrame([
        (1, 7, TODAY, "log:s:bench:62.5:8:3"), (2, 7, TODAY, "log:s:other:60:8:3"), (3, 7, TODAY, "log:e:bench"),
        (4, 7, TODAY, "log:s:bench:60:8"), (5, 7, TODAY, "log:s:bench:many:8:3"), (6, 7, TODAY, "log:x:bench:60:8:3")],
        "entry_id bigint, user_id bigint, workout_date date, payload string")
    assert rows(m.structured_log(t, entries), "entry_id", "raw_text") == [(1, "Bench 62.5×8×3"), (2, "other 60×8×3")]


def test_validation_order(make, spark):
    t = make(exercises=[(1, "bench", "Bench", "chest", "barbell"), (2, "dip", "Dip", "chest", "bodyweight")],
             events=[(1, 7, "2026-01-05T10:00:00", 1, 60, 8, 0), (2, 7, "2026-01-05T10:00:00", 1, 60, 0, 3),
                     (3, 7, "2026-01-05T10:00:00", 9, -1, 8, 3), (4, 7, "2026-01-05T10:00:00", 9, 0, 8, 3),
                     (5, 7, "2026-01-05T10:00:00", 1, 0, 8, 3), (6, 7, "2026-01-05T10:00:00", 2, 0, 8, 3)])
    assert dict(rows(m.validate_log(t, t["log_events"]), "event_id", "reason")) == {
        1: "bad_sets", 2: "bad_reps", 3: "bad_weight", 4: "unknown_exercise", 5: "zero_weight", 6: None}


BETWEEN = ["x", "х", "X", "×", "*", "/", " x ", " на ", " НА ", " × ", " кг на ", "kg x", " KG/ "]
COUNTED = ["", " ", " повтор", " повторений", " раз", " REPS", " reps5", " раз1"]
AROUND = ["", "жим ", "bench: ", "a", "сделал  "]


def test_numbers_of_composed_messages(spark):
    """Texts put together from known numbers: what was put in comes out."""
    rng = random.Random(3)
    cases = []
    for _ in range(500):
        weight, reps, sets = rng.choice(["66", "12,5", "0.5", "100"]), rng.randint(1, 30), rng.randint(1, 9)
        text = rng.choice(AROUND) + weight + rng.choice(BETWEEN) + str(reps) + rng.choice(COUNTED)
        if rng.random() < 0.6:
            # A third number stands after a sign, or after a blank where no word swallows it.
            text += rng.choice([" x ", " на ", "×", "*"]) + str(sets) + rng.choice(["", " подхода", "set", " сетов"])
        else:
            sets = 3
            text += rng.choice(["", " set2", " подход1", "."])
        cases.append((text, (float(weight.replace(",", ".")), reps, sets)))
    for _ in range(100):
        weight, reps, sets = rng.choice(["66", "12,5", "7.25"]), rng.randint(1, 30), rng.randint(1, 9)
        cases.append((f"{rng.choice(AROUND)}{weight} {reps}   {sets}", (float(weight.replace(",", ".")), reps, sets)))
    got = spark.createDataFrame([(x,) for x, _ in cases], "text string").select("text", parsing.parse_numbers(F.col("text")).alias("n")).collect()
    assert [(r["text"], tuple(r["n"])) for r in got] == cases


def test_control_characters_in_a_message_are_no_marks(spark, make):
    texts = ["\x0166x7\x01", "6\x017\x013", "6\x027\x023", "66x7\x013", "\x01\x01\x01"]
    got = spark.createDataFrame([(x,) for x in texts], "text string").select(parsing.parse_numbers(F.col("text")).alias("n")).collect()
    assert [tuple(r["n"]) if r["n"] else None for r in got] == [(66.0, 7, 3), None, None, (66.0, 7, 3), None]
    t = make(catalog_source=dictionary(spark, {"a": ("ab", []), "b": ("\x01b", ["c\x02"])}))
    msgs = spark.createDataFrame(list(enumerate(["\x01ab\x02", "a\x01b", "c\x02ab", "\x03ab\x04b"])), "msg_id bigint, text string")
    assert {r["msg_id"]: r["slugs"] for r in m.with_slugs(t, msgs).collect()} == {0: ["a"], 1: ["b"], 2: ["a", "b"], 3: ["a"]}


def test_huge_counts_are_a_log_that_cannot_be_saved(spark, make):
    t = make(exercises=[(1, "bench", "Bench", "chest", "barbell")], catalog_source=dictionary(spark, {"bench": ("Bench", ["жим"])}))
    texts = ["жим 66x99999999999", "жим 66x7x" + "9" * 60, "жим 99999x5", "жим 66x32768", "жим 66x7x3"]
    msgs = spark.createDataFrame([(i, 1, TODAY, x) for i, x in enumerate(texts)], "msg_id bigint, user_id bigint, msg_date date, text string")
    assert [o for _, o in rows(m.route_messages(t, msgs), "msg_id", "outcome")] == ["save_failed"] * 4 + ["saved"]


def test_large_dictionary_looks_places_up_and_not_lengths(spark, make):
    """Every place of a text is looked up once, whatever the lengths of the aliases."""
    rng = random.Random(5)
    entries = {f"s{i}": ("".join(rng.choices("abcdefghij", k=4 + i % 40)), []) for i in range(120)}
    t = make(catalog_source=dictionary(spark, entries))
    texts = ["".join(rng.choices("abcdefghij ", k=60)) + rng.choice(list(entries.values()))[0] for _ in range(50)]
    msgs = spark.createDataFrame(list(enumerate(texts)), "msg_id bigint, text string")
    found = {r["msg_id"]: r["slugs"] for r in m.with_slugs(t, msgs, limit=0).collect()}
    assert [found[i] for i in range(50)] == [greedy(entries, x) for x in texts]
    hits = m.alias_hits(t, msgs.select("msg_id", F.col("text").alias("norm")), ["msg_id"])
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 1  # one list of places; longer beginnings start from what was found
    assert {(r["msg_id"], r["lo"], r["alias"]) for r in hits.collect()} == {
        (i, at.start(), name) for i, x in enumerate(texts) for name, _ in entries.values() for at in re.finditer(f"(?={re.escape(name)})", x)}


@pytest.mark.parametrize("value,app,chat", [
    (66.0, "66", "66"), (32.5, "32.5", "32.5"), (12.34567, "12.34567", "12.3457"), (100.0, "100", "100"), (0.0, "0", "0"),
    (1e14, "100000000000000", "1e+14"), (1e15, "1000000000000000", "1e+15"), (999999.0, "999999", "999999"), (1e6, "1000000", "1e+06"),
    (1e300, "1.0E300", "1e+300"), (0.00001, "0.00001", "1e-05"),
])
def test_number_texts(spark, value, app, chat):
    row = spark.range(1).select(rules.plain_number(F.lit(value)).alias("a"), rules.general_number(F.lit(value)).alias("c")).first()
    assert (row["a"], row["c"]) == (app, chat) and chat == f"{value:g}"


def test_the_dictionary_is_no_column_of_the_messages(spark, t):
    one = spark.createDataFrame([(1, "lift b 50x5")], "msg_id bigint, text string")
    plan = m.with_slugs(t, one)._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in plan and "ubquery" not in plan


def test_short_numbers_are_written_as_before(spark):
    values = [0.0, 0.5, 1.0, 2.5, 66.0, 12.3457, 12.34567, 99999.0, 99999.9, 99998.5, 100000.0, 123456.7, 1e15, 32.505]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", rules.general_number(F.col("v")).alias("g")).collect()
    assert {r["v"]: r["g"] for r in got} == {v: f"{v:.6g}" for v in values}
    whole = spark.createDataFrame([("7",), ("100",), ("007",), ("-0",), ("2.50",), ("x",)], "v string")
    assert [r[0] for r in whole.select(rules.plain_number(F.col("v"))).collect()] == ["7", "100", "7", "0", "2.5", "x"]


def test_no_text_names_no_exercise(spark, t):
    none = spark.createDataFrame([(1, None, 5, TODAY)], "msg_id bigint, text string, user_id bigint, msg_date date")
    assert m.with_slugs(t, none).first()["slugs"] == []
    assert m.route_messages(t, none).first()["outcome"] == "pass_through"
