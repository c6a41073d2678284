"""The training log read from the star-schema parquet tables.

``Tables`` builds each view on first use, so a query touches only the files it
needs. A deployment with its own log files replaces the views with
``Tables(spark, path, views={...})`` or a plain dict of DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How the star schema is read as a training log (fixed values of the test views).
CATALOG_SIZE = 40        # parts and line items map onto this many exercises
CUSTOMERS_PER_USER = 10  # customers of one user

# Views that are dimensions, and how many rows such a view may have to be kept as local rows.
DIMENSIONS = ("exercises", "catalog_source")
MAX_DIMENSION_ROWS = 10_000
# Users asked for by id whose key ranges are handed to a scan.
MAX_FILTERED_USERS = 200
# Bytes of source files for each shuffle partition to begin with, and of shuffled rows up to which partitions are put together.
# A row in a task's hash table takes about twenty times its shuffled bytes.
INPUT_PER_PARTITION, SHUFFLED_PER_PARTITION = 8 << 20, 16 << 20

SOURCE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Declared schemas of the log tables, for writers and for reading production files.
LOG_SCHEMAS = {
    "profile": "user_id bigint not null, display_name string, birth_date date, height_cm smallint, "
               "weight_kg decimal(5,2), body_type string, occupation string, sleep_hours decimal(3,1), "
               "goal string, notes string, nutrition map<string,string>, created_at timestamp_ntz, "
               "updated_at timestamp_ntz",
    "goals": "goal_id bigint not null, user_id bigint not null, horizon string not null, description string not null, "
             "exercise_slug string, target_weight_kg decimal(6,2), target_reps smallint, "
             "status string not null, sort_order smallint not null",
    "injuries": "injury_id bigint not null, user_id bigint not null, body_part string not null, injury_type string not null, "
                "description string, status string not null, started_on date, resolved_on date, notes string",
    "exercise_bans": "ban_id bigint not null, user_id bigint not null, exercise_name string not null, reason string, "
                     "until_date date, is_active boolean not null",
    "training_split": "split_id bigint not null, user_id bigint not null, day_label string not null, focus string not null, "
                      "sort_order smallint not null, is_active boolean not null",
    "exercises": "exercise_id bigint not null, slug string not null, name string not null, "
                 "muscle_group string, equipment string, technique_notes string, ord int not null",
    "user_exercises": "user_id bigint not null, exercise_id bigint not null, split_id bigint, "
                      "role string not null, target_reps_min smallint, target_reps_max smallint, "
                      "target_sets smallint, sort_order smallint not null, is_active boolean not null",
    "workouts": "workout_id bigint not null, user_id bigint not null, workout_date date not null, "
                "split_focus string, duration_min smallint, overall_rpe smallint, notes string, "
                "created_at timestamp_ntz not null",
    "workout_sets": "workout_id bigint not null, exercise_id bigint not null, set_number smallint not null, "
                    "weight_kg decimal(6,2) not null, reps smallint not null, is_warmup boolean, rpe smallint",
    "catalog_source": "slug string not null, canonical string not null, muscle_group string, aliases array<string>, ord int not null",
}


def dimension(df: DataFrame, max_rows: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """A small table read once, as local rows with a broadcast hint.

    Each join with it then stays on the side of the facts, in batch and in every
    micro-batch, whatever the size of the files it is made of. A table beyond the
    bound is returned as it is.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def size_shuffles(spark: SparkSession, paths: list[str], each: int = INPUT_PER_PARTITION) -> None:
    """Let the number of shuffle partitions follow the input, so that a task's share does not grow with it.

    A larger number that is set already stays; adaptive execution puts small partitions together.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(paths[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    size = sum(fs.getContentSummary(p).getLength() for p in map(path, paths) if fs.exists(p))
    first, advised = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    set_already = int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if size // each > set_already:
        spark.conf.set(first, str(size // each))
        if spark.conf.get(advised, None) is None:
            spark.conf.set(advised, str(SHUFFLED_PER_PARTITION))


class Tables(dict):
    """Mapping of view name to DataFrame, filled on demand."""

    def __init__(self, spark: SparkSession, path: str, views: dict[str, Callable] | None = None):
        super().__init__()
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # log times are UTC
        self.spark = spark
        self.path = path.rstrip("/")
        size_shuffles(spark, [f"{self.path}/{name}.parquet" for name in SOURCE_SCHEMAS])
        self._views = {**VIEWS, **(views or {})}
        self._given: set[str] = set()

    def __missing__(self, name: str) -> DataFrame:
        if name in SOURCE_SCHEMAS:
            df = self.spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")
        else:
            df = self._views[name](self)
        if name in DIMENSIONS:
            df = dimension(df)
        self[name] = df
        return df

    def replaced(self, **frames: DataFrame) -> "Tables":
        """Same tables with some views swapped; views made from these follow, views swapped before stay."""
        other = Tables(self.spark, self.path, self._views)
        other.update({name: self[name] for name in self._given} | frames)
        other._given = self._given | set(frames)
        return other

    def of_users(self, name: str, users: list[int]) -> DataFrame:
        """A view's rows of some users, and others: the ids as ranges of the column that the scan can filter by."""
        if name != "workouts" or self._given & {"orders", "workouts"} or self._views[name] is not workouts or len(users) > MAX_FILTERED_USERS:
            return self[name]
        n, key = CUSTOMERS_PER_USER, F.col("o_custkey")
        wanted = F.lit(False)
        for u in users:
            wanted = wanted | key.between(u * n - (n - 1) * (u <= 0), u * n + (n - 1) * (u >= 0))
        return workouts(self.replaced(orders=self["orders"].where(wanted)))


# Declared defaults of columns that may be left out.
DEFAULTS = {"status": "active", "sort_order": 0, "is_active": True, "role": "base", "injury_type": "injury", "is_warmup": False}


def conform(df: DataFrame, name: str) -> DataFrame:
    """The rows with the declared columns of a log table, in its types.

    Columns that are left out get their default, else null; a declared column that
    must not be null and has no default has to be there. Others are dropped.
    """
    schema = df.sparkSession.createDataFrame([], LOG_SCHEMAS[name]).schema
    missing = [f.name for f in schema.fields if not f.nullable and f.name not in df.columns and f.name not in DEFAULTS]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*[
        (F.coalesce(f.name, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS and f.name in df.columns
         else F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def save_log(t, path: str) -> None:
    """Write the log tables with their declared columns, a folder each."""
    for name in LOG_SCHEMAS:
        conform(t[name], name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}.parquet")


def open_log(spark: SparkSession, path: str) -> Tables:
    """Tables over stored log tables; what is not stored keeps its view."""
    def reader(name):
        return lambda t: spark.read.schema(LOG_SCHEMAS[name]).parquet(f"{t.path}/{name}.parquet")

    return Tables(spark, path, views={name: reader(name) for name in LOG_SCHEMAS})


def register(spark: SparkSession, t: Tables, names=None) -> None:
    """Publish the views to plain Spark SQL."""
    for name in names or VIEWS:
        t[name].createOrReplaceTempView(name)


def by_value(col: str, mapping: dict, default=None):
    """CASE expression from a literal mapping."""
    expr = None
    for key, value in mapping.items():
        value = F.lit(value)
        expr = F.when(F.col(col) == key, value) if expr is None else expr.when(F.col(col) == key, value)
    return expr.otherwise(F.lit(default))


def exercises(t: Tables) -> DataFrame:
    """Catalog: parts grouped into exercises; the first part of a group names it."""
    first = F.min_by(F.struct("p_name", "p_type", "p_size"), "p_partkey").alias("p")
    return (
        t["part"]
        .groupBy((F.col("p_partkey") % CATALOG_SIZE).alias("exercise_id"))
        .agg(first)
        .select("exercise_id", "p.*")
        .select(
            "exercise_id",
            F.concat(F.lit("ex_"), F.col("exercise_id").cast("string")).alias("slug"),
            F.col("p_name").alias("name"),
            # A group outside the usual six, and an exercise without a group.
            F.when(F.col("exercise_id") % 13 == 5, "core").when(F.col("exercise_id") != 7, by_value("p_type", {
                "ECONOMY": "chest", "LARGE": "back", "MEDIUM": "biceps",
                "PROMO": "triceps", "SMALL": "shoulders", "STANDARD": "legs",
            })).alias("muscle_group"),
            F.when(F.col("p_size") % 5 == 0, "bodyweight").otherwise("barbell").alias("equipment"),
            F.col("exercise_id").cast("int").alias("ord"),
        )
    )


def workouts(t: Tables) -> DataFrame:
    return t["orders"].select(
        F.col("o_orderkey").alias("workout_id"),
        F.expr(f"o_custkey div {CUSTOMERS_PER_USER}").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("workout_date"),
        by_value("o_orderpriority", {
            "1-URGENT": "Chest + Biceps", "2-HIGH": "Back + Triceps",
            "3-MEDIUM": "Shoulders", "4-NOT SPECIFIED": "Logged",
        }).alias("split_focus"),
        F.expr("nullif(cast(o_orderkey % 12 as int), 5)").alias("overall_rpe"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 0, cast(o_orderkey % 86400 as int))").alias("created_at"),
    )


def workout_sets(t: Tables) -> DataFrame:
    """One row per line item; a repeated set number is left in for the quality report."""
    return t["lineitem"].select(
        F.col("l_orderkey").alias("workout_id"),
        set_exercise().alias("exercise_id"),
        F.col("l_linenumber").alias("set_number"),
        ((F.col("l_quantity") % 12) * 2.5).cast("decimal(6,2)").alias("weight_kg"),
        (F.col("l_linenumber") + 1).alias("reps"),
        F.when(F.col("l_tax") > 0, F.round(F.col("l_discount") * 100).cast("int")).alias("rpe"),
    )


def set_exercise():
    """Exercise of a line item; the last one is rare, so that users without it exist."""
    own = F.col("l_partkey") % CATALOG_SIZE
    rare = (own == CATALOG_SIZE - 1) & (F.col("l_orderkey") % 50 != 0)
    return F.when(rare, CATALOG_SIZE - 2).otherwise(own)


def log_events(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t["events"].select(
        "event_id", "user_id", "ts",
        F.col("ts").cast("date").alias("workout_date"),
        (k % (CATALOG_SIZE + 1)).alias("exercise_id"),  # the last id is not in the catalog
        (F.floor(F.col("value") / 2.5) * 2.5).cast("decimal(6,2)").alias("weight_kg"),
        (k % 9).cast("int").alias("reps"),
        (F.col("event_id") % 5).cast("int").alias("sets_count"),
    )


def all_profiles(t: Tables) -> DataFrame:
    """One row per user from the user's first customer, with its account balance."""
    first = F.min_by(F.struct("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey").alias("c")
    return (
        t["customer"]
        .groupBy(F.expr(f"c_custkey div {CUSTOMERS_PER_USER}").alias("user_id"))
        .agg(first)
        .select("user_id", "c.*")
        .select(
            "user_id",
            F.col("c_name").alias("display_name"),
            (F.col("c_nationkey") + 150).cast("int").alias("height_cm"),
            (F.col("c_nationkey") * 1.5 + 50).cast("decimal(5,2)").alias("weight_kg"),
            F.lower("c_mktsegment").alias("body_type"),
            F.col("c_mktsegment").alias("goal"),
            F.when(F.col("c_nationkey") % 3 > 0, F.col("c_name")).alias("notes"),
            F.create_map("c_mktsegment", "c_nationkey").alias("nutrition"),
            F.col("c_acctbal").alias("acctbal"),
        )
    )


def profile(t: Tables) -> DataFrame:
    """Registered users: those whose account is not overdrawn."""
    return t["all_profiles"].where("acctbal >= 0").drop("acctbal")


def local_profiles(t: Tables) -> DataFrame:
    """Profiles kept outside the table, the second source of ``profile_or_fallback``."""
    return t["all_profiles"].where("acctbal >= -500").drop("acctbal")


def _per_customer(t: Tables) -> DataFrame:
    return t["customer"].withColumn("user_id", F.expr(f"c_custkey div {CUSTOMERS_PER_USER}"))


def goals(t: Tables) -> DataFrame:
    c = _per_customer(t)
    return c.select(
        F.col("c_custkey").alias("goal_id"), "user_id",
        F.expr("element_at(array('short', 'medium', 'long'), c_nationkey % 3 + 1)").alias("horizon"),
        F.concat(F.lit("target for "), F.col("c_name")).alias("description"),
        (F.col("c_custkey") % CATALOG_SIZE).alias("exercise_id"),
        (F.col("c_nationkey") * 2.5 + 20).cast("decimal(6,2)").alias("target_weight_kg"),
        F.expr("element_at(array('active', 'active', 'achieved', 'paused'), c_nationkey % 4 + 1)").alias("status"),
        F.expr(f"cast(c_custkey % {CUSTOMERS_PER_USER} as int)").alias("sort_order"),
    )


def injuries(t: Tables) -> DataFrame:
    return _per_customer(t).select(
        "user_id",
        F.col("c_mktsegment").alias("body_part"),
        F.expr("element_at(array('active', 'recovering', 'resolved'), c_nationkey % 3 + 1)").alias("status"),
        F.when(F.col("c_nationkey") % 2 > 0, F.col("c_name")).alias("notes"),
        F.col("c_custkey").alias("injury_id"),
    )


def exercise_bans(t: Tables) -> DataFrame:
    """Free text: a plain exercise name or one of its spoken aliases."""
    c = _per_customer(t).withColumn("exercise_id", F.col("c_custkey") % CATALOG_SIZE)
    return c.join(t["exercises"].select("exercise_id", "name"), "exercise_id").select(
        "user_id",
        F.when(F.col("c_nationkey") % 2 == 0, F.col("name"))
        .otherwise(F.concat(F.lit("No "), spoken_alias(F.col("exercise_id")), F.lit("!")))
        .alias("exercise_name"),
        F.when(F.col("c_nationkey") % 4 > 0, F.col("c_mktsegment")).otherwise(
            F.when(F.col("c_nationkey") % 8 == 0, F.lit(""))).alias("reason"),
        (F.col("c_nationkey") % 3 != 0).alias("is_active"),
        F.col("c_custkey").alias("ban_id"),
    )


def training_split(t: Tables) -> DataFrame:
    return _per_customer(t).select(
        "user_id",
        by_value("c_mktsegment", {
            "AUTOMOBILE": "Mon/Tue", "BUILDING": "Mon/Tue", "FURNITURE": "Wed/Thu",
            "HOUSEHOLD": "Wed/Thu", "MACHINERY": "Fri/Sat",
        }).alias("day_label"),
        F.expr("element_at(array('Chest + Biceps', 'Back + Triceps', 'Shoulders (+ legs sometimes)', "
               "'Full body'), c_nationkey % 4 + 1)").alias("focus"),
        F.expr(f"cast(c_custkey % {CUSTOMERS_PER_USER} as int)").alias("sort_order"),
        (F.col("c_nationkey") % 5 != 0).alias("is_active"),
        F.col("c_custkey").alias("split_id"),
    )


def user_exercises(t: Tables) -> DataFrame:
    return _per_customer(t).select(
        "user_id",
        F.expr(f"(c_custkey * 7) % {CATALOG_SIZE}").alias("exercise_id"),
        (F.col("c_custkey") + 1).alias("split_id"),
        F.expr("element_at(array('base', 'accessory', 'warmup'), c_nationkey % 3 + 1)").alias("role"),
    )


def spoken_alias(exercise_id):
    """'lift ' and the id in letters, so that an alias never contains a number."""
    return F.concat(F.lit("lift "), F.translate(exercise_id.cast("string"), "0123456789", "abcdefghij"))


def catalog_source(t: Tables) -> DataFrame:
    """Alias dictionary: slug, canonical name, muscle group and the list of aliases."""
    alias = spoken_alias(F.col("exercise_id"))
    return t["exercises"].select(
        "slug",
        # Some names of the dictionary differ from the table's.
        F.when(F.col("ord") % 4 == 1, F.concat(F.col("name"), F.lit(" (main)"))).otherwise(F.col("name")).alias("canonical"),
        "muscle_group",
        F.array(
            alias, F.upper(alias), F.concat(F.lit(" "), alias, F.lit(" set")),
            F.concat(alias, F.lit(" work")), F.concat(F.lit("my "), alias),
            F.concat(alias, F.lit(" ёlite")), F.concat(F.lit("old "), alias), F.lit(""),
        ).alias("aliases"),
        "ord",
    )


def messages(t: Tables) -> DataFrame:
    """Chat messages: the first set of each (workout, exercise), worded by template."""
    order = (F.col("set_number").cast("bigint") * 1_000_000 + (F.col("weight_kg") * 100).cast("bigint")) * 67_108_864 + F.col("reps")
    logged = (
        t["workout_sets"]
        .groupBy("workout_id", "exercise_id")
        .agg(F.min_by("weight_kg", order).alias("weight_kg"), F.min_by("reps", order).alias("reps"))
        .join(t["workouts"].select("workout_id", "user_id", F.col("workout_date").alias("msg_date")), "workout_id")
    )
    alias = spoken_alias(F.col("exercise_id"))
    other = spoken_alias((F.col("exercise_id") + 1) % CATALOG_SIZE)
    w = F.rtrim(F.rtrim(F.col("weight_kg").cast("string"), F.lit("0")), F.lit("."))  # decimals: zeros before the point stay
    r = F.col("reps").cast("string")
    s = (F.col("workout_id") % 4 + 1).cast("string")
    template = F.col("workout_id") % 12
    text = (
        F.when(template == 0, F.concat(alias, F.lit(" "), w, F.lit("×"), r, F.lit("×"), s))
        .when(template == 1, F.concat(alias, F.lit(" "), w, F.lit(" кг на "), r, F.lit(" повторов на "), s,
                                      F.lit(" подхода")))
        .when(template == 2, F.concat(alias, F.lit(" "), w, F.lit("x"), r))
        .when(template == 3, F.concat(alias, F.lit(" "), w, F.lit(" "), r, F.lit(" "), s))
        .when(template == 4, F.concat(F.lit("вчера "), alias, F.lit(" "), w, F.lit("*"), r, F.lit("*"), s))
        .when(template == 5, F.concat(F.lit("сделал "), alias))
        .when(template == 6, F.concat(F.lit("составь программу "), alias))
        .when(template == 7, F.concat(alias, F.lit(" "), w, F.lit("x"), r, F.lit(" reps5")))
        .when(template == 8, F.concat(alias, F.lit(" "), w, F.lit("x"), r, F.lit(" подход0")))
        .when(template == 9, F.concat(alias, F.lit(" 999999999999999x"), r))
        .when(template == 10, F.concat(alias, F.lit(" "), w, F.lit(",4567 kg x "), r, F.lit(" раз1 x "), s, F.lit(" set2")))
        .otherwise(F.concat(alias, F.lit(" и "), other, F.lit(" "), w, F.lit("×"), r, F.lit("×"), s,
                            F.lit(" 07.06")))
    )
    return logged.select(
        (F.col("workout_id") * CATALOG_SIZE + F.col("exercise_id")).alias("msg_id"),
        "user_id", "msg_date", text.alias("text"),
    )


def dated_workouts(t: Tables) -> DataFrame:
    """Workouts that already exist on the days of the event log, some still in progress."""
    return t["orders"].select(
        F.col("o_orderkey").alias("workout_id"),
        F.expr(f"o_custkey div {CUSTOMERS_PER_USER}").alias("user_id"),
        F.expr("date_add(date'2024-01-01', cast(o_orderkey % 30 as int))").alias("workout_date"),
        by_value("o_orderpriority", {
            "1-URGENT": "Chest", "2-HIGH": "Back + Triceps", "3-MEDIUM": "In progress", "4-NOT SPECIFIED": "Legs",
        }, "Shoulders").alias("split_focus"),
        F.expr("cast(date_add(date'2024-01-01', cast(o_orderkey % 30 as int)) as timestamp_ntz)"
               " + make_dt_interval(0, 0, 0, cast(o_orderkey % 86400 as int))").alias("created_at"),
    )


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "exercises": exercises,
    "workouts": workouts,
    "workout_sets": workout_sets,
    "log_events": log_events,
    "all_profiles": all_profiles,
    "profile": profile,
    "local_profiles": local_profiles,
    "goals": goals,
    "injuries": injuries,
    "exercise_bans": exercise_bans,
    "training_split": training_split,
    "user_exercises": user_exercises,
    "catalog_source": catalog_source,
    "messages": messages,
    "dated_workouts": dated_workouts,
}
