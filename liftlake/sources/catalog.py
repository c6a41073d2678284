"""Exercise catalog and alias dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlake.functions import parsing, rules
from liftlake.operators.common import one_per_key

CATALOG_SCHEMA = "slug string, canonical string, muscle_group string, aliases array<string>, ord int"

# Alias tables up to this size travel to every task as one pattern and one map.
MAX_LITERAL_ALIASES = 2_000


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Alias dictionary kept as JSON lines; lines that are no objects are skipped."""
    rows = spark.read.schema(CATALOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.where("slug is not null")


def catalog_from_dict(spark: SparkSession, entries: dict) -> DataFrame:
    """Dictionary slug -> {canonical, muscle_group, aliases}; other values are skipped."""
    rows = [
        (slug, str(meta.get("canonical") or slug), meta.get("muscle_group"),
         [str(a) for a in meta.get("aliases") or []], i)
        for i, (slug, meta) in enumerate(entries.items()) if isinstance(meta, dict)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def alias_table(catalog: DataFrame) -> DataFrame:
    """One row per (slug, normalised alias).

    The canonical name follows the aliases unless it is one of them; ``pos`` keeps
    the first place an alias appears at within its slug.
    """
    spoken = F.transform("aliases", lambda a: F.trim(parsing.normalized(a)))
    names = F.array_append(spoken, F.trim(parsing.normalized(F.col("canonical"))))
    return (
        catalog.select("slug", "canonical", "muscle_group", "ord",
                       F.posexplode(F.array_distinct(names)).alias("pos", "alias"))
        .where("alias <> ''")
        .withColumn("size", F.length("alias"))
    )


def alias_entries(catalog: DataFrame) -> DataFrame:
    return alias_table(catalog).select("alias", "slug", "canonical", "ord", F.col("size").alias("alias_len"))


def _trie_pattern(words: list[str]) -> str:
    """Regular expression for the longest of the words that begins at a place; common beginnings are shared.

    After each common beginning at most one way goes on, so matching takes time in the
    length of the match and not in the number of words.
    """
    root: dict = {}
    for word in words:
        node = root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def of(node: dict) -> str:
        straight = []  # characters that leave no choice
        while len(node) == 1 and "" not in node:
            (char, node), = node.items()
            straight.append(_literal(char))
        ways = [_literal(char) + of(node[char]) for char in sorted(node) if char]
        rest = f"(?:{'|'.join(ways)})" + "?" * ("" in node) if ways else ""
        return "".join(straight) + rest

    return of(root)


def _literal(char: str) -> str:
    return "\\" + char if char.isascii() and not char.isalnum() else char


@dataclass(frozen=True)
class AliasMatcher:
    """What finds the aliases in a text: a pattern, and for each alias the ones it begins with, first the one that is taken first."""

    pattern: str
    entries: list[dict[str, list[dict]]]  # in buckets by the alias' hash
    # Two characters that mark hits in a text, and one that takes their place where the text holds them; none is in an alias.
    marks: tuple[str, str, str]

    @property
    def buckets(self) -> int:
        return len(self.entries)


ENTRIES = "array<map<string, array<struct<neg_size:int, ord:int, pos:int, size:int, slug:string>>>>"


def alias_matcher(t, limit: int = MAX_LITERAL_ALIASES) -> AliasMatcher | None:
    """Matcher for a dictionary of at most ``limit`` aliases, read once; None beyond."""
    kept = t.__dict__.setdefault("_alias_matcher", {}) if hasattr(t, "__dict__") else {}
    if limit not in kept:
        rows = alias_table(t["catalog_source"]).select(
            "alias", "slug", "size", "ord", "pos", F.xxhash64("alias").alias("hash")).limit(limit + 1).collect()
        kept[limit] = _matcher(rows) if len(rows) <= limit else None
    return kept[limit]


def _matcher(rows) -> AliasMatcher:
    named: dict[str, list[dict]] = {}
    for r in rows:
        named.setdefault(r["alias"], []).append(
            {"neg_size": -r["size"], "ord": r["ord"], "pos": r["pos"], "size": r["size"], "slug": r["slug"]})
    used = {c for alias in named for c in alias}
    marks = tuple(c for c in map(chr, range(1, 32)) if c not in used and not c.isspace())[:3]
    if len(marks) < 3:
        raise ValueError("the aliases hold nearly all control characters")
    # Nulls come first, as where Spark sorts.
    order = lambda e: (e["neg_size"], e["ord"] is not None, e["ord"] or 0, e["pos"], e["slug"])
    hashes = {r["alias"]: r["hash"] for r in rows}
    buckets: list[dict] = [{} for _ in hashes]
    for alias, number in hashes.items():
        begun = [e for n in range(1, len(alias) + 1) for e in named.get(alias[:n], ())]
        buckets[number % len(buckets)][alias] = sorted(begun, key=order)
    return AliasMatcher(_trie_pattern(list(named)), buckets, marks)


def catalog_by_muscle(t, muscle=None) -> DataFrame:
    """Catalog of a muscle group in catalog order; an unknown group gives no rows."""
    c = t["catalog_source"].where("muscle_group is not null")
    if muscle is not None:
        c = c.where(F.col("muscle_group") == muscle)
    order = Window.partitionBy("muscle_group").orderBy("ord")
    return c.select("muscle_group", "slug", F.col("canonical").alias("name"),
                    F.row_number().over(order).alias("position"))


def values_source(t, rows: list[tuple]) -> DataFrame:
    """Inline literal sets (slug, set_number, weight, reps) joined to the catalog by slug.

    ``times_reached`` counts the logged sets of the exercise at or above the literal one.
    """
    literal = t["exercises"].sparkSession.createDataFrame(
        rows, "slug string, set_number int, weight_kg double, reps int"
    ).withColumn("weight_kg", F.col("weight_kg").cast("decimal(6,2)"))
    wanted = literal.join(t["exercises"].select("exercise_id", "slug", "name", "muscle_group"), "slug")
    sets = t["workout_sets"].groupBy("exercise_id", F.col("weight_kg").alias("w"), F.col("reps").alias("r")).agg(
        F.count(F.lit(1)).alias("n"))
    reached = F.when((F.col("w") >= F.col("weight_kg")) & (F.col("r") >= F.col("reps")), F.col("n")).otherwise(0)
    return (
        wanted.join(sets, "exercise_id", "left")
        .groupBy("slug", "name", "muscle_group", "set_number", "weight_kg", "reps")
        .agg(F.coalesce(F.sum(reached), F.lit(0)).cast("bigint").alias("times_reached"))
        .withColumn("weight_kg", F.col("weight_kg").cast("double"))
    )


def seed_missing(catalog: DataFrame, seed: DataFrame) -> DataFrame:
    """Catalog plus the seed rows whose slug is not in it yet; running it twice changes nothing.

    Of several rows of a slug the first one is taken: the smallest ``ord`` where the
    seed has one, then the smallest row by its values.
    """
    first = one_per_key(seed, ["slug"], oldest=["ord"] if "ord" in seed.columns else [])
    return catalog.unionByName(first.join(catalog.select("slug"), "slug", "left_anti"))


def muscle_order(groups: DataFrame) -> DataFrame:
    """Distinct muscle groups with label and the two display positions.

    Unknown groups follow the known ones alphabetically and keep their id as label.
    """
    known = groups.select("muscle_group").where("muscle_group is not null").distinct()
    slot = rules.display_position(F.col("muscle_group"), rules.MUSCLE_ORDER)
    picker = rules.display_position(F.col("muscle_group"), rules.PICKER_ORDER)
    # One row per distinct group id is left here, a handful of them.
    return known.select(
        "muscle_group",
        rules.muscle_label(F.col("muscle_group")).alias("label"),
        F.row_number().over(Window.orderBy(slot, "muscle_group")).alias("position"),
        F.row_number().over(Window.orderBy(picker, "muscle_group")).alias("picker_position"),
    )
