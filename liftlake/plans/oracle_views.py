"""The log views as SQL, for the queries' SQL twins.

Written independently of the DataFrame views: windows and self joins where those
use ordered aggregates.
"""

from __future__ import annotations

CHAT_FOCUS = ("CASE WHEN muscle_group IN ('chest', 'back', 'biceps', 'triceps', 'shoulders', 'legs') "
              "THEN upper(muscle_group[1]) || muscle_group[2:] ELSE 'Logged' END")

# view -> (views it needs, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "exercises": ("", """
        SELECT exercise_id, 'ex_' || exercise_id AS slug, p_name AS name,
               CASE WHEN exercise_id % 13 = 5 THEN 'core' WHEN exercise_id = 7 THEN NULL ELSE CASE p_type WHEN 'ECONOMY' THEN 'chest' WHEN 'LARGE' THEN 'back' WHEN 'MEDIUM' THEN 'biceps'
                    WHEN 'PROMO' THEN 'triceps' WHEN 'SMALL' THEN 'shoulders' WHEN 'STANDARD' THEN 'legs' END END AS muscle_group,
               CASE WHEN p_size % 5 = 0 THEN 'bodyweight' ELSE 'barbell' END AS equipment,
               CAST(exercise_id AS INTEGER) AS ord
        FROM (SELECT *, p_partkey % 40 AS exercise_id,
                     row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS rn FROM part)
        WHERE rn = 1"""),
    "workouts": ("", """
        SELECT o_orderkey AS workout_id, o_custkey // 10 AS user_id, CAST(o_orderdate AS DATE) AS workout_date,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Chest + Biceps' WHEN '2-HIGH' THEN 'Back + Triceps'
                    WHEN '3-MEDIUM' THEN 'Shoulders' WHEN '4-NOT SPECIFIED' THEN 'Logged' END AS split_focus,
               nullif(CAST(o_orderkey % 12 AS INTEGER), 5) AS overall_rpe,
               o_orderdate + to_seconds(o_orderkey % 86400) AS created_at
        FROM orders"""),
    "workout_sets": ("", """
        SELECT l_orderkey AS workout_id,
               CASE WHEN l_partkey % 40 = 39 AND l_orderkey % 50 <> 0 THEN 38 ELSE l_partkey % 40 END AS exercise_id, l_linenumber AS set_number,
               CAST((l_quantity % 12) * 2.5 AS DECIMAL(6,2)) AS weight_kg, l_linenumber + 1 AS reps,
               CASE WHEN l_tax > 0 THEN CAST(round(l_discount * 100) AS INTEGER) END AS rpe
        FROM lineitem"""),
    "log_events": ("", """
        SELECT event_id, user_id, ts, CAST(ts AS DATE) AS workout_date,
               CAST(json_extract(props, '$.k') AS BIGINT) % 41 AS exercise_id,
               CAST(floor(value / 2.5) * 2.5 AS DECIMAL(6,2)) AS weight_kg,
               CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 9 AS INTEGER) AS reps,
               CAST(event_id % 5 AS INTEGER) AS sets_count
        FROM events"""),
    "all_profiles": ("", """
        SELECT user_id, c_name AS display_name, c_nationkey + 150 AS height_cm,
               CAST(c_nationkey * 1.5 + 50 AS DECIMAL(5,2)) AS weight_kg, lower(c_mktsegment) AS body_type,
               c_mktsegment AS goal, CASE WHEN c_nationkey % 3 > 0 THEN c_name END AS notes,
               '{"' || c_mktsegment || '": ' || c_nationkey || '}' AS nutrition, c_acctbal AS acctbal
        FROM (SELECT *, c_custkey // 10 AS user_id,
                     row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) AS rn FROM customer)
        WHERE rn = 1"""),
    "profile": ("all_profiles", "SELECT * EXCLUDE (acctbal) FROM all_profiles WHERE acctbal >= 0"),
    "local_profiles": ("all_profiles", "SELECT * EXCLUDE (acctbal) FROM all_profiles WHERE acctbal >= -500"),
    "goals": ("", """
        SELECT c_custkey // 10 AS user_id,
               CASE c_nationkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS horizon,
               'target for ' || c_name AS description,
               CASE c_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'achieved' ELSE 'paused' END AS status,
               CAST(c_custkey % 10 AS INTEGER) AS sort_order
        FROM customer"""),
    "injuries": ("", """
        SELECT c_custkey // 10 AS user_id, c_mktsegment AS body_part,
               CASE c_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'recovering' ELSE 'resolved' END AS status,
               CASE WHEN c_nationkey % 2 > 0 THEN c_name END AS notes, c_custkey AS injury_id
        FROM customer"""),
    "exercise_bans": ("exercises", """
        SELECT c_custkey // 10 AS user_id,
               CASE WHEN c_nationkey % 2 = 0 THEN e.name
                    ELSE 'No lift ' || translate(CAST(e.exercise_id AS VARCHAR), '0123456789', 'abcdefghij') || '!' END AS exercise_name,
               CASE WHEN c_nationkey % 4 > 0 THEN c_mktsegment WHEN c_nationkey % 8 = 0 THEN '' END AS reason,
               c_nationkey % 3 <> 0 AS is_active, c_custkey AS ban_id
        FROM customer JOIN exercises e ON e.exercise_id = c_custkey % 40"""),
    "training_split": ("", """
        SELECT c_custkey // 10 AS user_id,
               CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Mon/Tue'
                    WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Wed/Thu'
                    WHEN c_mktsegment = 'MACHINERY' THEN 'Fri/Sat' END AS day_label,
               CASE c_nationkey % 4 WHEN 0 THEN 'Chest + Biceps' WHEN 1 THEN 'Back + Triceps'
                    WHEN 2 THEN 'Shoulders (+ legs sometimes)' ELSE 'Full body' END AS focus,
               CAST(c_custkey % 10 AS INTEGER) AS sort_order, c_nationkey % 5 <> 0 AS is_active, c_custkey AS split_id
        FROM customer"""),
    "user_exercises": ("", """
        SELECT c_custkey // 10 AS user_id, (c_custkey * 7) % 40 AS exercise_id, c_custkey + 1 AS split_id,
               CASE c_nationkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'accessory' ELSE 'warmup' END AS role
        FROM customer"""),
    "spoken": ("exercises", """
        SELECT *, 'lift ' || translate(CAST(exercise_id AS VARCHAR), '0123456789', 'abcdefghij') AS a FROM exercises"""),
    "catalog_source": ("spoken", """
        SELECT slug, CASE WHEN ord % 4 = 1 THEN name || ' (main)' ELSE name END AS canonical, muscle_group, ord,
               [a, upper(a), ' ' || a || ' set', a || ' work', 'my ' || a, a || ' ёlite', 'old ' || a, ''] AS aliases
        FROM spoken"""),
    "alias_rows": ("catalog_source", """
        SELECT slug, canonical, ord, alias, min(pos) AS pos, length(alias) AS size
        FROM (SELECT slug, canonical, ord, trim(replace(lower(raw), 'ё', 'е')) AS alias, pos
              FROM (SELECT slug, canonical, ord, unnest(list_append(aliases, canonical)) AS raw,
                           generate_subscripts(list_append(aliases, canonical), 1) AS pos FROM catalog_source))
        WHERE alias <> '' GROUP BY slug, canonical, ord, alias"""),
    "messages": ("workouts workout_sets spoken", """
        SELECT m.workout_id * 40 + m.exercise_id AS msg_id, w.user_id, w.workout_date AS msg_date,
               CASE m.workout_id % 12
                 WHEN 0 THEN x.a || ' ' || m.wt || '×' || m.reps || '×' || m.s
                 WHEN 1 THEN x.a || ' ' || m.wt || ' кг на ' || m.reps || ' повторов на ' || m.s || ' подхода'
                 WHEN 2 THEN x.a || ' ' || m.wt || 'x' || m.reps
                 WHEN 3 THEN x.a || ' ' || m.wt || ' ' || m.reps || ' ' || m.s
                 WHEN 4 THEN 'вчера ' || x.a || ' ' || m.wt || '*' || m.reps || '*' || m.s
                 WHEN 5 THEN 'сделал ' || x.a
                 WHEN 6 THEN 'составь программу ' || x.a
                 WHEN 7 THEN x.a || ' ' || m.wt || 'x' || m.reps || ' reps5'
                 WHEN 8 THEN x.a || ' ' || m.wt || 'x' || m.reps || ' подход0'
                 WHEN 9 THEN x.a || ' 999999999999999x' || m.reps
                 WHEN 10 THEN x.a || ' ' || m.wt || ',4567 kg x ' || m.reps || ' раз1 x ' || m.s || ' set2'
                 ELSE x.a || ' и ' || y.a || ' ' || m.wt || '×' || m.reps || '×' || m.s || ' 07.06' END AS text
        FROM (SELECT *, workout_id % 4 + 1 AS s, regexp_replace(CAST(weight_kg AS VARCHAR), '\\.?0+$', '') AS wt,
                     row_number() OVER (PARTITION BY workout_id, exercise_id ORDER BY set_number, weight_kg, reps) AS rn
              FROM workout_sets) m
        JOIN workouts w USING (workout_id)
        JOIN spoken x ON x.exercise_id = m.exercise_id
        JOIN spoken y ON y.exercise_id = (m.exercise_id + 1) % 40
        WHERE rn = 1"""),
    "dated_workouts": ("", """
        SELECT o_orderkey AS workout_id, o_custkey // 10 AS user_id,
               DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS workout_date,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Chest' WHEN '2-HIGH' THEN 'Back + Triceps'
                    WHEN '3-MEDIUM' THEN 'In progress' WHEN '4-NOT SPECIFIED' THEN 'Legs' ELSE 'Shoulders' END AS split_focus,
               CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS created_at
        FROM orders"""),
    "seed_rows": ("", """
        SELECT 'ex_' || n AS slug, upper(p_name) AS name, lower(p_type) AS muscle_group
        FROM (SELECT *, p_partkey % 60 AS n, row_number() OVER (PARTITION BY p_partkey % 60 ORDER BY p_partkey) AS rn FROM part)
        WHERE rn = 1"""),
    "logged": ("workouts workout_sets exercises", """
        SELECT w.workout_id, w.user_id, w.workout_date, w.created_at, e.exercise_id, e.slug, e.name, e.muscle_group,
               e.equipment = 'bodyweight' AS bw, e.ord, s.set_number, s.weight_kg, s.reps
        FROM workouts w JOIN workout_sets s USING (workout_id) JOIN exercises e USING (exercise_id)"""),
    "tops": ("logged", """
        SELECT m.user_id, m.slug, m.workout_date, CAST(m.max_weight AS DOUBLE) AS max_weight,
               max(l.reps) AS reps, count(*) AS sets_count, any_value(l.bw) AS bw
        FROM (SELECT user_id, slug, workout_date, max(weight_kg) AS max_weight FROM logged GROUP BY ALL) m
        JOIN logged l ON l.user_id = m.user_id AND l.slug = m.slug AND l.workout_date = m.workout_date
                     AND l.weight_kg = m.max_weight
        GROUP BY m.user_id, m.slug, m.workout_date, m.max_weight"""),
    "tonnages": ("logged", """
        SELECT user_id, slug, workout_date, CAST(sum(weight_kg * reps) AS DOUBLE) AS tonnage, count(*) AS sets_count
        FROM logged GROUP BY user_id, slug, workout_date"""),
    # newest workout per (user, exercise, date)
    "day_logs": ("logged", """
        SELECT l.user_id, l.exercise_id, l.workout_date, l.workout_id, CAST(min(l.weight_kg) AS DOUBLE) AS weight_kg,
               min(l.reps) AS reps, count(*) AS sets_count
        FROM logged l
        JOIN (SELECT DISTINCT ON (user_id, exercise_id, workout_date) user_id, exercise_id, workout_date, workout_id
              FROM logged ORDER BY user_id, exercise_id, workout_date, created_at DESC, workout_id DESC) n
          USING (user_id, exercise_id, workout_date, workout_id)
        GROUP BY ALL"""),
    # newest workout per (user, exercise) with its first set
    "last_logs": ("logged", """
        SELECT n.user_id, n.exercise_id, n.workout_date,
               first(l.weight_kg ORDER BY l.set_number, l.weight_kg, l.reps) AS weight_kg,
               first(l.reps ORDER BY l.set_number, l.weight_kg, l.reps) AS reps, count(*) AS sets_count
        FROM (SELECT DISTINCT ON (user_id, exercise_id) user_id, exercise_id, workout_date, workout_id
              FROM logged ORDER BY user_id, exercise_id, workout_date DESC, created_at DESC, workout_id DESC) n
        JOIN logged l USING (user_id, exercise_id, workout_id)
        GROUP BY n.user_id, n.exercise_id, n.workout_date"""),
    "hist": ("workouts", """
        SELECT workout_id, user_id, workout_date, split_focus, CAST(position AS INTEGER) AS position
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY workout_date, created_at, workout_id) AS position
              FROM workouts) WHERE position <= 50"""),
    "last_dates": ("workouts workout_sets", """
        SELECT user_id, max(workout_date) AS last_date FROM workouts w
        WHERE EXISTS (SELECT 1 FROM workout_sets s WHERE s.workout_id = w.workout_id) GROUP BY user_id"""),
    "summary_rows": ("logged workouts last_dates exercises", """
        SELECT f.user_id, f.last_date AS workout_date,
               (SELECT trim(w.split_focus) FROM workouts w
                WHERE w.user_id = f.user_id AND w.workout_date = f.last_date AND w.split_focus IS NOT NULL
                  AND trim(w.split_focus) <> '' AND w.split_focus <> 'Logged'
                ORDER BY w.created_at DESC, w.workout_id DESC LIMIT 1) AS split_focus,
               f.exercise_id, f.weight_kg, f.reps, f.sets_count
        FROM (SELECT d.user_id, d.last_date, n.exercise_id,
                     first(l.weight_kg ORDER BY l.set_number, l.weight_kg, l.reps) AS weight_kg,
                     first(l.reps ORDER BY l.set_number, l.weight_kg, l.reps) AS reps, count(*) AS sets_count
              FROM last_dates d
              JOIN (SELECT DISTINCT ON (l.user_id, l.exercise_id) l.user_id, l.exercise_id, l.workout_id
                    FROM logged l JOIN last_dates d ON d.user_id = l.user_id AND d.last_date = l.workout_date
                    ORDER BY l.user_id, l.exercise_id, l.created_at DESC, l.workout_id DESC) n ON n.user_id = d.user_id
              JOIN logged l ON l.workout_id = n.workout_id AND l.exercise_id = n.exercise_id
              GROUP BY d.user_id, d.last_date, n.exercise_id) f"""),
    # distinct-date counts of registered users over the whole catalog
    "overview": ("profile exercises logged day_logs", """
        SELECT p.user_id, e.muscle_group, e.slug, e.name, e.exercise_id, e.equipment = 'bodyweight' AS bw,
               (coalesce(c.n, 0)) AS session_count
        FROM profile p CROSS JOIN exercises e
        LEFT JOIN (SELECT user_id, exercise_id, count(DISTINCT workout_date) AS n FROM logged GROUP BY ALL) c
          ON c.user_id = p.user_id AND c.exercise_id = e.exercise_id"""),
    "overview_fixed": ("overview day_logs", """
        SELECT o.*, d.user_id IS NOT NULL AS is_logged_today, d.weight_kg AS last_weight_kg, d.reps AS last_reps,
               d.sets_count AS last_sets_count,
               CAST(row_number() OVER (PARTITION BY o.user_id, o.muscle_group ORDER BY o.session_count DESC, o.name, o.slug) AS INTEGER) AS position
        FROM overview o LEFT JOIN day_logs d ON d.user_id = o.user_id AND d.exercise_id = o.exercise_id
                                            AND d.workout_date = DATE '1998-06-15'"""),
    # accepted events with their muscle group
    "valid_events": ("log_events exercises", """
        SELECT v.*, e.slug, e.muscle_group FROM log_events v JOIN exercises e USING (exercise_id)
        WHERE v.sets_count > 0 AND v.reps > 0 AND v.weight_kg >= 0 AND (v.weight_kg > 0 OR e.equipment = 'bodyweight')"""),
    "app_events": ("valid_events", """
        SELECT *, CASE muscle_group WHEN 'chest' THEN 'Chest + Biceps' WHEN 'back' THEN 'Back + Triceps'
                       WHEN 'legs' THEN 'Legs' ELSE 'Logged' END AS focus FROM valid_events"""),
    "chat_events": ("valid_events", """
        SELECT *, """ + CHAT_FOCUS + """ AS focus FROM valid_events"""),
}


def replay(events: str, existing: str | None, variants: bool, live_day: str | None = None) -> str:
    """Recursive views replaying the events of every (user, date) one by one.

    The state is the list of workouts of the day, newest first.
    """
    old = (f"(SELECT list({{'f': split_focus, 'k': CAST(workout_id AS VARCHAR)}} ORDER BY created_at DESC, workout_id DESC) "
           f"FROM {existing} x WHERE x.user_id = q.user_id AND x.workout_date = q.workout_date)") if existing else "NULL"
    newest = (f"(SELECT max(created_at) FROM {existing} x WHERE x.user_id = q.user_id AND x.workout_date = q.workout_date)"
              if existing else "NULL")
    fits = "w.f = e.focus OR w.f = 'Logged'"
    if variants:
        fits += " OR (e.muscle_group = 'back' AND w.f IN ('Back', 'Back + Triceps'))" \
                " OR (e.muscle_group = 'chest' AND w.f IN ('Chest', 'Chest + Biceps'))"
    cont = (f"WHEN e.workout_date = DATE '{live_day}' AND r.ws[1].f = 'In progress' "
            f"AND e.ts <= r.newest + INTERVAL 6 HOUR THEN r.ws[1].k ") if live_day else ""
    return f"""
        numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, workout_date ORDER BY ts, event_id) AS rn FROM {events}),
        day_state AS (SELECT q.user_id, q.workout_date,
                             coalesce({old}, CAST([] AS STRUCT(f VARCHAR, k VARCHAR)[])) AS ws,
                             CAST({newest} AS TIMESTAMP) AS newest
                      FROM (SELECT DISTINCT user_id, workout_date FROM numbered) q),
        steps AS (
          SELECT user_id, workout_date, CAST(0 AS BIGINT) AS rn, ws, newest, CAST(NULL AS BIGINT) AS event_id,
                 CAST(NULL AS VARCHAR) AS focus, CAST(NULL AS VARCHAR) AS key
          FROM day_state
          UNION ALL
          SELECT user_id, workout_date, rn,
                 CASE WHEN hit IS NULL THEN list_prepend({{'f': focus, 'k': new_key}}, ws) ELSE ws END,
                 newest, event_id, focus, coalesce(hit, new_key)
          FROM (
            SELECT e.user_id, e.workout_date, e.rn, r.ws, r.newest, e.event_id, e.focus,
                   CASE WHEN len(list_filter(r.ws[1:5], lambda w: {fits})) > 0
                        THEN list_filter(r.ws[1:5], lambda w: {fits})[1].k {cont} END AS hit,
                   e.user_id || '|' || e.workout_date || '|' || e.focus ||
                     CASE WHEN len(list_filter(r.ws, lambda w: w.k = e.user_id || '|' || e.workout_date || '|' || e.focus)) > 0
                          THEN '|' || e.event_id ELSE '' END AS new_key
            FROM steps r JOIN numbered e ON e.user_id = r.user_id AND e.workout_date = r.workout_date AND e.rn = r.rn + 1
          )
        ),
        attached AS (SELECT s.event_id, s.user_id, s.workout_date, s.focus AS event_focus, s.key AS workout_key,
                            n.ts, n.exercise_id, n.weight_kg, n.reps, n.sets_count
                     FROM steps s JOIN numbered n USING (event_id) WHERE s.rn > 0)"""


def with_views(needs: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """Full statement: the needed views, extra views and the query."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0].split():
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in order]
    if extra:
        parts.append(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
