"""Scalar rules against literal expectations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from liftlake.functions import rules
from liftlake.operators import quality, reports
from liftlake.sources import catalog


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("text,value", [
    ("12,5", 12.5), (" 12.5 ", 12.5), ("", None), ("  ", None), ("abc", None), ("1,2,3", None), ("-5", -5.0),
    (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("1d", None), ("Infinity", None), ("NaN", None), ("+7", 7.0),
])
def test_parse_decimal(spark, text, value):
    assert one(spark, rules.parse_decimal(F.lit(text))) == value


@pytest.mark.parametrize("text,loaded,bodyweight", [
    ("", None, 0.0), ("0", None, 0.0), ("-1", None, None), ("2,5", 2.5, 2.5), ("x", None, None)])
def test_log_weight(spark, text, loaded, bodyweight):
    assert one(spark, rules.parse_log_weight(F.lit(text), F.lit(False))) == loaded
    assert one(spark, rules.parse_log_weight(F.lit(text), F.lit(True))) == bodyweight


@pytest.mark.parametrize("weight,reps,sets,bw,label", [
    ("60", "8", "3", False, "60 кг × 8 × 3"), ("60,5", "8", "3", False, "60.5 кг × 8 × 3"),
    ("", "8", "3", False, None), ("", "8", "3", True, "8 × 3"), ("oops", "8", "3", True, "8 × 3"),
    ("5", "8", "3", True, "+5 кг × 8 × 3"), ("60", "", "3", False, None), ("60", "8", "0", False, None),
    ("60", "2.5", "3", False, "60 кг × 2.5 × 3"), ("-5", "8", "3", True, "8 × 3"),
])
def test_entry_preview(spark, weight, reps, sets, bw, label):
    assert one(spark, rules.entry_preview(F.lit(weight), F.lit(reps), F.lit(sets), F.lit(bw))) == label


def test_session_label_forms(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 4, 5, 11, 12, 14, 21, 22, 25, 101, 111, 112, 122)], "n bigint")
    got = {r["n"]: r["v"].split(" ")[1] for r in df.select("n", rules.session_label(F.col("n")).alias("v")).collect()}
    assert [n for n, w in sorted(got.items()) if w == "тренировка"] == [1, 21, 101]
    assert [n for n, w in sorted(got.items()) if w == "тренировки"] == [2, 4, 22, 122]


def test_day_labels(spark):
    monday = dt.date(2026, 1, 5)
    got = [one(spark, rules.day_label(F.lit(monday + dt.timedelta(days=i)))) for i in range(7)]
    assert got == ["Mon/Tue"] * 2 + ["Wed/Thu"] * 2 + ["Fri/Sat"] * 3


def test_focus_rules(spark):
    f = lambda m, rule: one(spark, rules.split_focus(F.lit(m), rule))
    assert [f(m, "app") for m in ("chest", "back", "legs", "biceps", None)] == [
        "Chest + Biceps", "Back + Triceps", "Legs", "Logged", "Logged"]
    assert [f(m, "chat") for m in ("chest", "biceps", "unknown", None)] == ["Chest", "Biceps", "Logged", "Logged"]


def test_labels(spark):
    lab = lambda b, w, r, s: one(spark, rules.set_label(F.lit(b), F.lit(w), F.lit(r), F.lit(s)))
    assert lab(False, 100.0, 10, 3) == "100 кг × 10 × 3"
    assert lab(True, 0.0, 10, 3) == "10 × 3"
    assert lab(True, 2.5, 10, 3) == "+2.5 кг × 10 × 3"
    point = lambda b, w: one(spark, rules.session_point_label(F.lit(b), F.lit(w), F.lit(10), F.lit(3)))
    assert (point(True, 0.0), point(True, 5.0)) == ("10 × 3", "5 кг × 10 × 3")


def test_json_text(spark):
    m = F.create_map(F.lit('a"b'), F.lit("x, y"), F.lit("ё"), F.lit("z"))
    assert one(spark, rules.json_text(m)) == '{"a\\"b": "x, y", "ё": "z"}'


def test_muscle_order(spark):
    groups = spark.createDataFrame([("legs",), ("zeta",), ("back",), ("alpha",), ("chest",), ("biceps",)], "muscle_group string")
    got = {r["muscle_group"]: r for r in catalog.muscle_order(groups).collect()}
    by = lambda k: sorted(got, key=lambda m: got[m][k])
    assert by("position") == ["chest", "back", "biceps", "legs", "alpha", "zeta"]
    assert by("picker_position") == ["chest", "biceps", "back", "legs", "alpha", "zeta"]
    assert got["alpha"]["label"] == "alpha"


def test_allowed_users(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    assert rows(reports.allowed_users(df, " 1, ,3,")) == [(1,), (3,)]
    with pytest.raises(ValueError):
        reports.allowed_users(df, " , ")
    with pytest.raises(ValueError):
        reports.allowed_users(df, spark.createDataFrame([(" , ",)], "ids string"))


def test_catalog_dictionary(spark):
    c = catalog.catalog_from_dict(spark, {
        "bench": {"canonical": "Жим лёжа", "muscle_group": "chest", "aliases": ["Жим", "жим ", "ЖИМ ЛЕЖА"]},
        "broken": "no dictionary", "bare": {}})
    got = rows(catalog.alias_entries(c), "alias", "slug", "alias_len")
    assert set(got) == {("bare", "bare", 4), ("жим", "bench", 3), ("жим лежа", "bench", 8)}


def test_seeding_is_idempotent(spark):
    base = spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, name string")
    seed = spark.createDataFrame([("b", "other"), ("c", "C")], "slug string, name string")
    once = catalog.seed_missing(base, seed)
    assert rows(once) == [("a", "A"), ("b", "B"), ("c", "C")]
    assert rows(catalog.seed_missing(once, seed)) == rows(once)


def test_quality_nulls_pass_range_checks(make):
    t = make([(1, 7, "2026-01-05", None)], [(1, 1, 1, 50.0, 8)], [(1, "a", "A", "chest", "barbell")])
    t["workouts"] = t["workouts"].withColumn("overall_rpe", F.lit(None).cast("int"))
    assert quality.range_violations(t).count() == 0
