"""SQL twins of the registered queries, for an independent engine."""

from __future__ import annotations

from liftlake.plans.oracle_views import CHAT_FOCUS, replay, with_views

AS_OF = "DATE '1998-06-15'"


def num(x: str) -> str:
    """Shortest decimal text."""
    return (f"coalesce(regexp_replace(CAST(TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,12)) AS VARCHAR), '\\.?0+$', ''), "
            f"CAST({x} AS VARCHAR))")


def general(x: str) -> str:
    """Text with six significant digits."""
    return f"format('{{:g}}', CAST({x} AS DOUBLE))"


def flt(x: str) -> str:
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


def loaded(w: str, r: str, s: str) -> str:
    return f"{num(w)} || ' кг × ' || {num(r)} || ' × ' || {num(s)}"


def label(bw: str, w: str, r: str, s: str) -> str:
    return (f"CASE WHEN {bw} AND {w} > 0 THEN '+' || {loaded(w, r, s)} "
            f"WHEN {bw} THEN {num(r)} || ' × ' || {num(s)} ELSE {loaded(w, r, s)} END")


def point_label(bw: str, w: str, r: str, s: str) -> str:
    return f"CASE WHEN {bw} AND {w} = 0 THEN {num(r)} || ' × ' || {num(s)} ELSE {loaded(w, r, s)} END"


def day_label(d: str) -> str:
    return f"CASE WHEN isodow({d}) IN (1, 2) THEN 'Mon/Tue' WHEN isodow({d}) IN (3, 4) THEN 'Wed/Thu' ELSE 'Fri/Sat' END"


PLAN_MUSCLES = (
    "CASE focus WHEN 'Chest + Biceps' THEN ['chest', 'biceps'] WHEN 'Back + Triceps' THEN ['back', 'triceps'] "
    "WHEN 'Shoulders (+ legs sometimes)' THEN ['shoulders', 'legs'] "
    "ELSE ['chest', 'back', 'biceps', 'triceps', 'shoulders', 'legs'] END"
)
ORDER_ALL = "['chest', 'back', 'biceps', 'triceps', 'shoulders', 'legs']"
ORDER_PICK = "['chest', 'biceps', 'back', 'triceps', 'shoulders', 'legs']"

LITERALS = ("(VALUES ('ex_0', 1, 20.0, 6), ('ex_0', 2, 20.0, 6), ('ex_0', 3, 22.5, 5), ('ex_5', 1, 12.5, 8), "
            "('ex_5', 2, 12.5, 8), ('ex_17', 1, 5.0, 7), ('ex_39', 1, 27.5, 3), ('no_such_exercise', 1, 10.0, 10)) "
            "AS v(slug, set_number, weight_kg, reps)")
PLAN_ROWS = ("(VALUES ('Mon/Tue', 'Chest + Biceps', 1), ('Wed/Thu', 'Back + Triceps', 2), "
             "('Fri/Sat', 'Shoulders (+ legs sometimes)', 3)) AS v(day_label, focus, sort_order)")

FORM = """
    form AS (
      SELECT l_orderkey AS workout_id, l_partkey % 40 AS exercise_id, l_linenumber AS set_number,
             CASE l_suppkey % 8 WHEN 0 THEN replace(n, '.', ',') WHEN 1 THEN '  ' || n || ' ' WHEN 2 THEN ''
                  WHEN 3 THEN '-' || n WHEN 4 THEN n || ',5,1' WHEN 5 THEN n || ' kg' WHEN 6 THEN '0' ELSE n END AS weight_text,
             CASE WHEN l_discount > 0.08 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS reps_text,
             CASE WHEN l_tax > 0.07 THEN 'x3' ELSE """ + num("round(l_tax * 50, 1)") + """ END AS sets_text
      FROM (SELECT *, """ + num("CAST(l_quantity AS DECIMAL(18,2)) / 2") + """ AS n FROM lineitem))"""

# Typed number: the first comma is a decimal point; words and leftovers make it unreadable.
DECIMAL = ("CASE WHEN trim({t}) <> '' THEN try_cast(CASE WHEN contains(trim({t}), ',') THEN "
           "trim({t})[1:strpos(trim({t}), ',') - 1] || '.' || trim({t})[strpos(trim({t}), ',') + 1:] "
           "ELSE trim({t}) END AS DOUBLE) END")

# Messages: occurrences of aliases, folded longest first.
RESOLVE = """
    norm AS (SELECT msg_id, user_id, trim(replace(lower(text), 'ё', 'е')) AS t FROM {src}),
    occ AS (
      SELECT msg_id, user_id, lo, lo + size AS hi, slug,
             row_number() OVER (PARTITION BY msg_id ORDER BY size DESC, ord, pos, lo) AS rn
      FROM (SELECT n.msg_id, n.user_id, a.*, unnest(list_filter(range(1, length(n.t) - a.size + 2),
                     lambda i: substr(n.t, i, a.size) = a.alias)) AS lo
            FROM norm n JOIN alias_rows a ON contains(n.t, a.alias))),
    fold AS (
      SELECT msg_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(lo BIGINT, hi BIGINT, slug VARCHAR)[]) AS kept FROM norm
      UNION ALL
      SELECT f.msg_id, o.rn,
             CASE WHEN len(list_filter(f.kept, lambda k: o.lo < k.hi AND k.lo < o.hi)) > 0 THEN f.kept
                  ELSE list_append(f.kept, {{'lo': o.lo, 'hi': o.hi, 'slug': o.slug}}) END
      FROM fold f JOIN occ o ON o.msg_id = f.msg_id AND o.rn = f.rn + 1),
    spans AS (
      SELECT msg_id, unnest(kept, recursive := true), generate_subscripts(kept, 1) AS i
      FROM (SELECT DISTINCT ON (msg_id) msg_id, kept FROM fold ORDER BY msg_id, rn DESC)),
    firsts AS (SELECT msg_id, slug, min(i) AS i FROM spans GROUP BY msg_id, slug),
    found AS (SELECT msg_id, slug, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY i) - 1 AS INTEGER) AS position FROM firsts)"""

P_WEIGHT = (r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(?:кг|kg)?\s*(?:на|x|х|×|\*|/)\s*([0-9]+)\s*"
            r"(?:повтор[\p{L}\p{N}_]*|rep[\p{L}\p{N}_]*|раз[\p{L}\p{N}_]*)?\s*(?:(?:на|x|х|×|\*|/)\s*)?([0-9]+)?\s*"
            r"(?:подход[\p{L}\p{N}_]*|сет[\p{L}\p{N}_]*|set[\p{L}\p{N}_]*)?")
P_TRIPLE = r"([0-9]+(?:[.,][0-9]+)?)\s+([0-9]+)\s+([0-9]+)"
# ASCII word boundaries do here: no letter of another script touches a number in the messages.
P_DATE = r"\b([0-9]{1,2})[./]([0-9]{1,2})(?:[./]([0-9]{2,4}))?\b"


def _group(pattern: str, i: int) -> str:
    return f"regexp_extract(trim(text), '{pattern}', {i})"


def _count(pattern: str, i: int) -> str:
    """A count; the largest integer stands for larger ones."""
    return f"CAST(least(try_cast({_group(pattern, i)} AS DECIMAL(38,0)), 2147483647) AS INTEGER)"


NUMBERS = f"""
    nums AS (
      SELECT msg_id, CASE WHEN w1 > 0 AND r1 > 0 AND s1 > 0 THEN w1 WHEN w2 > 0 AND r2 > 0 AND s2 > 0 THEN w2 END AS weight_kg,
             CASE WHEN w1 > 0 AND r1 > 0 AND s1 > 0 THEN r1 WHEN w2 > 0 AND r2 > 0 AND s2 > 0 THEN r2 END AS reps,
             CASE WHEN w1 > 0 AND r1 > 0 AND s1 > 0 THEN s1 WHEN w2 > 0 AND r2 > 0 AND s2 > 0 THEN s2 END AS sets
      FROM (SELECT msg_id, try_cast(replace({_group(P_WEIGHT, 1)}, ',', '.') AS DOUBLE) AS w1,
                   {_count(P_WEIGHT, 2)} AS r1,
                   CASE WHEN {_group(P_WEIGHT, 3)} = '' THEN 3 ELSE {_count(P_WEIGHT, 3)} END AS s1,
                   try_cast(replace({_group(P_TRIPLE, 1)}, ',', '.') AS DOUBLE) AS w2,
                   {_count(P_TRIPLE, 2)} AS r2,
                   {_count(P_TRIPLE, 3)} AS s2
            FROM messages))"""
DATES = f"""
    days AS (
      SELECT msg_id, CASE WHEN contains(lt, 'сегодня') OR contains(lt, 'today') THEN msg_date
                          WHEN contains(lt, 'вчера') OR contains(lt, 'yesterday') THEN CAST(msg_date - 1 AS DATE)
                          ELSE coalesce(try_cast(CASE WHEN y = '' THEN CAST(year(msg_date) AS VARCHAR)
                                WHEN length(y) = 2 THEN '20' || y ELSE lpad(y, 4, '0') END
                                || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE), msg_date) END AS workout_date
      FROM (SELECT *, lower(text) AS lt, {_group(P_DATE, 1)} AS d, {_group(P_DATE, 2)} AS m, {_group(P_DATE, 3)} AS y FROM messages))"""
HINT = "сделал|отработал|записал|потренировал|прошел|сегодня жим"
ASK = "программ|пропиши|план трен|что делать|что мне делать|с чего начать|напиши трен|составь|подскажи упражн"
PARSED = f"""
    parsed AS (
      SELECT m.msg_id, m.user_id, f.slug, coalesce(n.weight_kg, 0) AS weight_kg, coalesce(n.reps, 0) AS reps,
             coalesce(n.sets, 0) AS sets, d.workout_date,
             f.slug IS NOT NULL AND (n.weight_kg IS NOT NULL OR (regexp_matches(lower(m.text), '{HINT}')
               AND NOT regexp_matches(lower(m.text), '{ASK}'))) AS is_log,
             CASE WHEN n.weight_kg IS NOT NULL AND c.n = 1 THEN 'high' ELSE 'medium' END AS confidence
      FROM messages m LEFT JOIN found f ON f.msg_id = m.msg_id AND f.position = 0
      LEFT JOIN (SELECT msg_id, count(*) AS n FROM found GROUP BY msg_id) c ON c.msg_id = m.msg_id
      JOIN nums n ON n.msg_id = m.msg_id JOIN days d ON d.msg_id = m.msg_id)"""
MESSAGE_SQL = RESOLVE.format(src="messages") + "," + NUMBERS + "," + DATES + "," + PARSED
SUMMARY = (f"CASE WHEN p.confidence = 'medium' AND p.weight_kg = 0 THEN c.canonical || ' (уточни вес и повторы)' "
           f"ELSE c.canonical || ': ' || {general('p.weight_kg')} || ' кг × ' || p.reps || ' × ' || p.sets || ' (' || p.workout_date || ')' END")

# Report texts over the history window.
DETAILS = f"""
    details AS (
      SELECT s.workout_id, s.exercise_id, count(DISTINCT (s.weight_kg, s.reps)) = 1 AS uniform, count(*) AS sets_count,
             CASE WHEN count(DISTINCT (s.weight_kg, s.reps)) = 1
                  THEN {flt('min(s.weight_kg)')} || ' kg × ' || min(s.reps) || ' × ' || count(*)
                  ELSE string_agg({flt('s.weight_kg')} || '×' || s.reps, ', ' ORDER BY s.weight_kg, s.reps) END AS detail
      FROM workout_sets s GROUP BY s.workout_id, s.exercise_id)"""
BLOCKS = DETAILS + """,
    lifts AS (
      SELECT h.user_id, c.slug, c.ord, count(*) AS sessions,
             '**' || c.canonical || ':**' || chr(10) || string_agg('  - ' || h.workout_date || ' (' || coalesce(h.split_focus, '') || '): '
               || d.detail, chr(10) ORDER BY h.position) || chr(10) AS block
      FROM hist h JOIN details d USING (workout_id) JOIN exercises e USING (exercise_id) JOIN catalog_source c ON c.slug = e.slug
      GROUP BY h.user_id, c.slug, c.ord, c.canonical),
    log_blocks AS (
      SELECT h.user_id, h.workout_id, h.position,
             '### ' || h.workout_date || coalesce(' (' || nullif(h.split_focus, '') || ')', '') || chr(10)
               || coalesce(string_agg('- ' || e.name || ': ' || d.detail, chr(10) ORDER BY e.ord), '- (no sets logged)')
               || chr(10) AS block
      FROM hist h LEFT JOIN details d USING (workout_id) LEFT JOIN exercises e USING (exercise_id)
      GROUP BY h.user_id, h.workout_id, h.position, h.workout_date, h.split_focus)"""
ALIAS_LINE = """'- **' || canonical || '** (`' || slug || '`): ' || (SELECT string_agg('«' || a || '»', ', ' ORDER BY i)
               FROM (SELECT unnest(c.aliases[1:6]) AS a, generate_subscripts(c.aliases[1:6], 1) AS i))
               || CASE WHEN len(aliases) > 6 THEN ' (+' || (len(aliases) - 6) || ' more)' ELSE '' END"""
FOCUS_COUNTS = """
    fc AS (SELECT user_id, coalesce(nullif(split_focus, ''), 'Unknown') AS focus, count(*) AS workouts FROM hist GROUP BY ALL),
    focus_rows AS (
      SELECT user_id, focus, workouts,
             CAST(sum(CASE WHEN contains(lower(focus), 'chest') THEN workouts ELSE 0 END) OVER (PARTITION BY user_id) AS BIGINT) AS chest_related,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY workouts DESC, focus) AS INTEGER) AS position FROM fc)"""
DOCUMENTS = BLOCKS + "," + FOCUS_COUNTS + f""",
    alias_text AS (
      SELECT chr(10) || '## Exercise name aliases (user chat → database)' || chr(10)
             || 'When the user names an exercise informally, map it to the canonical name and slug below.' || chr(10) || chr(10)
             || string_agg({ALIAS_LINE}, chr(10) ORDER BY ord) AS text FROM catalog_source c),
    docs AS (
      SELECT p.user_id, coalesce(f.total, 0) AS logged_workouts, coalesce(k.n, 0) AS n_lifts,
             concat_ws(chr(10), '## Profile', '- Name: ' || display_name,
               '- Weight: ' || {flt('weight_kg')} || ' kg, height: ' || height_cm,
               '- Body type: ' || body_type || ', goal: ' || goal, '- Notes: ' || coalesce(notes, '—'),
               '- Total logged workouts: ' || coalesce(f.total, 0), '- Nutrition: ' || nutrition,
               s.t, g.t, i.t, b.t,
               chr(10) || '## Workout session counts (full log)' || chr(10)
                 || '- Chest-related sessions (Chest / Chest + Biceps): **' || coalesce(f.chest, 0) || '**', f.t,
               (SELECT text FROM alias_text), k.t, l.t) AS document
      FROM profile p
      LEFT JOIN (SELECT user_id, chr(10) || '## Training split (plan)' || chr(10)
                   || string_agg('- ' || day_label || ': ' || focus, chr(10) ORDER BY sort_order) AS t
                 FROM training_split WHERE is_active GROUP BY user_id) s ON s.user_id = p.user_id
      LEFT JOIN (SELECT user_id, chr(10) || '## Active goals' || chr(10)
                   || string_agg('- [' || horizon || '] ' || description, chr(10) ORDER BY horizon, sort_order) AS t
                 FROM goals WHERE status = 'active' GROUP BY user_id) g ON g.user_id = p.user_id
      LEFT JOIN (SELECT user_id, chr(10) || '## Injuries / limitations' || chr(10)
                   || string_agg('- ' || body_part || ' (' || status || '): ' || coalesce(notes, '—'), chr(10) ORDER BY injury_id) AS t
                 FROM injuries WHERE status IN ('active', 'recovering') GROUP BY user_id) i ON i.user_id = p.user_id
      LEFT JOIN (SELECT user_id, chr(10) || '## Banned exercises' || chr(10)
                   || string_agg('- ' || exercise_name || ' — ' || coalesce(nullif(reason, ''), 'banned'), chr(10) ORDER BY ban_id) AS t
                 FROM exercise_bans WHERE is_active GROUP BY user_id) b ON b.user_id = p.user_id
      LEFT JOIN (SELECT user_id, CAST(sum(workouts) AS BIGINT) AS total, max(chest_related) AS chest,
                        string_agg('- ' || focus || ': ' || workouts, chr(10) ORDER BY position) AS t
                 FROM focus_rows GROUP BY user_id) f ON f.user_id = p.user_id
      LEFT JOIN (SELECT user_id, count(*) AS n, chr(10) || '## Key lift progression (every logged session)' || chr(10)
                   || string_agg(block, chr(10) ORDER BY ord) AS t FROM lifts GROUP BY user_id) k ON k.user_id = p.user_id
      LEFT JOIN (SELECT user_id, chr(10) || '## Full workout log (all sessions, chronological)' || chr(10)
                   || string_agg(block, chr(10) ORDER BY position) AS t FROM log_blocks GROUP BY user_id) l ON l.user_id = p.user_id)"""
MATCHED = """
    matched AS (
      SELECT f.msg_id, '## Exercises detected in user message' || chr(10)
             || string_agg('- User likely means: **' || c.canonical || '** (slug: `' || f.slug || '`)', chr(10) ORDER BY f.position)
             || chr(10) || chr(10) || 'Use progression data for these slugs below. Do not say the exercise is missing from the log.' AS text
      FROM found f JOIN catalog_source c USING (slug) GROUP BY f.msg_id)"""
FOCUSED = """
    focused AS (
      SELECT f.msg_id, '## Focused exercise history (matched from user message)' || chr(10)
             || string_agg(b.block, chr(10) ORDER BY f.position) AS text
      FROM found f JOIN messages m USING (msg_id) JOIN lifts b ON b.user_id = m.user_id AND b.slug = f.slug GROUP BY f.msg_id)"""

TODAY = f"""
    plan AS (
      SELECT user_id, workout_date, focus, {PLAN_MUSCLES} AS muscles
      FROM (SELECT t.user_id, a.as_of AS workout_date, t.focus,
                   row_number() OVER (PARTITION BY t.user_id ORDER BY t.sort_order, t.focus) AS rn
            FROM training_split t JOIN asked_day a ON a.user_id = t.user_id WHERE t.day_label = {day_label('a.as_of')}) WHERE rn = 1),
    today AS (
      SELECT p.user_id, p.workout_date, p.focus, e.slug, e.name, e.muscle_group, d.user_id IS NOT NULL AS is_logged_today,
             d.weight_kg AS last_weight_kg, d.reps AS last_reps, d.sets_count AS last_sets_count
      FROM plan p JOIN exercises e ON list_contains(p.muscles, e.muscle_group)
      LEFT JOIN day_logs d ON d.user_id = p.user_id AND d.exercise_id = e.exercise_id AND d.workout_date = p.workout_date
      WHERE EXISTS (SELECT 1 FROM logged l WHERE l.user_id = p.user_id AND l.exercise_id = e.exercise_id))"""
TODAY_OUT = ("SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY is_logged_today DESC, name, slug) AS INTEGER) "
             "AS position FROM today")

ATTACH_OUT = "SELECT event_id, user_id, workout_date, event_focus, workout_key FROM attached"

UNIQUE = {"profile": ["user_id"], "exercises": ["slug"], "user_exercises": ["user_id", "exercise_id"],
          "workout_sets": ["workout_id", "exercise_id", "set_number"]}
NOT_NULL = {
    "profile": ["user_id"], "goals": ["user_id", "horizon", "description", "status", "sort_order"],
    "injuries": ["user_id", "body_part", "status"], "exercise_bans": ["user_id", "exercise_name", "is_active"],
    "training_split": ["user_id", "day_label", "focus", "sort_order", "is_active"], "exercises": ["slug", "name"],
    "user_exercises": ["user_id", "exercise_id", "role"], "workouts": ["user_id", "workout_date", "created_at"],
    "workout_sets": ["workout_id", "exercise_id", "set_number", "weight_kg", "reps"],
}
FKS = [("goals", "user_id", "profile", "user_id"), ("injuries", "user_id", "profile", "user_id"),
       ("exercise_bans", "user_id", "profile", "user_id"), ("training_split", "user_id", "profile", "user_id"),
       ("user_exercises", "user_id", "profile", "user_id"), ("user_exercises", "exercise_id", "exercises", "exercise_id"),
       ("user_exercises", "split_id", "training_split", "split_id"), ("workouts", "user_id", "profile", "user_id"),
       ("workout_sets", "workout_id", "workouts", "workout_id"), ("workout_sets", "exercise_id", "exercises", "exercise_id")]


def _key(cols: list[str]) -> str:
    return " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)


def all_sql() -> dict[str, str]:
    v = with_views
    kept = "NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = x.user_id)"
    q = {
        # scans and sources
        "scan_log": v("workouts workout_sets", """
            SELECT w.user_id, w.workout_id, w.workout_date, w.split_focus, s.exercise_id, s.set_number,
                   CAST(s.weight_kg AS DOUBLE) AS weight_kg, s.reps FROM workouts w JOIN workout_sets s USING (workout_id)"""),
        "scan_catalog": v("alias_rows", "SELECT alias, slug, canonical, ord, CAST(size AS INTEGER) AS alias_len FROM alias_rows"),
        "values_source": v("exercises workout_sets", f"""
            SELECT v.slug, e.name, e.muscle_group, v.set_number, CAST(v.weight_kg AS DOUBLE) AS weight_kg, v.reps,
                   (SELECT count(*) FROM workout_sets s WHERE s.exercise_id = e.exercise_id AND s.weight_kg >= v.weight_kg
                    AND s.reps >= v.reps) AS times_reached
            FROM {LITERALS} JOIN exercises e USING (slug)"""),
        "catalog_by_muscle": v("catalog_source", """
            SELECT muscle_group, slug, canonical AS name, CAST(row_number() OVER (PARTITION BY muscle_group ORDER BY ord) AS INTEGER) AS position
            FROM catalog_source WHERE muscle_group IS NOT NULL"""),
        "nutrition_map": """SELECT event_id, '{"k": ' || CAST(json_extract(props, '$.k') AS INTEGER) || '}' AS props_json,
                                   CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""",
        # predicates and scalar rules
        "active_goals": v("goals", "SELECT user_id, horizon, description, sort_order FROM goals WHERE status = 'active'"),
        "current_injuries": v("injuries", """SELECT user_id, injury_id, body_part, status, coalesce(notes, '—') AS notes
            FROM injuries WHERE status <> 'resolved'"""),
        "active_bans": v("exercise_bans", """SELECT user_id, ban_id, exercise_name,
            CASE WHEN reason IS NULL OR reason = '' THEN 'banned' ELSE reason END AS reason FROM exercise_bans WHERE is_active"""),
        "active_split": v("training_split", "SELECT user_id, day_label, focus, sort_order FROM training_split WHERE is_active"),
        "split_focus_rpc": v("log_events exercises", """SELECT event_id, muscle_group, CASE muscle_group
            WHEN 'chest' THEN 'Chest + Biceps' WHEN 'back' THEN 'Back + Triceps' WHEN 'legs' THEN 'Legs' ELSE 'Logged' END AS focus
            FROM log_events LEFT JOIN exercises USING (exercise_id)"""),
        "split_focus_bot": v("log_events exercises", """SELECT event_id, muscle_group,
            """ + CHAT_FOCUS + """ AS focus FROM log_events LEFT JOIN exercises USING (exercise_id)"""),
        "focus_to_muscles": v("training_split", f"SELECT split_id, focus, array_to_string({PLAN_MUSCLES}, ',') AS muscles FROM training_split"),
        "day_label": v("workouts", f"SELECT workout_id, workout_date, {day_label('workout_date')} AS day_label FROM workouts"),
        "date_label": v("workouts", "SELECT workout_id, strftime(workout_date, '%d.%m') AS date_label FROM workouts"),
        "session_label": v("logged", """
            SELECT user_id, slug, session_count, session_count || ' ' || CASE
              WHEN session_count % 10 = 1 AND session_count % 100 <> 11 THEN 'тренировка'
              WHEN session_count % 10 BETWEEN 2 AND 4 AND (session_count % 100 < 10 OR session_count % 100 >= 20) THEN 'тренировки'
              ELSE 'тренировок' END AS label
            FROM (SELECT user_id, slug, count(DISTINCT workout_date) AS session_count FROM logged GROUP BY ALL)"""),
        "set_label": v("logged", f"""SELECT workout_id, exercise_id, set_number,
            {label('bw', 'weight_kg', 'reps', 'set_number')} AS label,
            {point_label('bw', 'weight_kg', 'reps', 'set_number')} AS point_label FROM logged"""),
        "is_bodyweight": v("exercises", "SELECT slug, equipment, equipment = 'bodyweight' AS is_bodyweight FROM exercises"),
        "muscle_order": v("exercises", f"""
            SELECT muscle_group, CASE muscle_group WHEN 'chest' THEN 'Грудь' WHEN 'back' THEN 'Спина' WHEN 'biceps' THEN 'Бицепс'
                     WHEN 'triceps' THEN 'Трицепс' WHEN 'shoulders' THEN 'Плечи' WHEN 'legs' THEN 'Ноги' ELSE muscle_group END AS label,
                   CAST(row_number() OVER (ORDER BY coalesce(nullif(list_position({ORDER_ALL}, muscle_group), 0), 99), muscle_group) AS INTEGER) AS position,
                   CAST(row_number() OVER (ORDER BY coalesce(nullif(list_position({ORDER_PICK}, muscle_group), 0), 99), muscle_group) AS INTEGER) AS picker_position
            FROM (SELECT muscle_group FROM exercises WHERE muscle_group IS NOT NULL UNION SELECT lower(p_type) FROM part)"""),
        "parse_decimal": v("", f"""
            SELECT workout_id, exercise_id, set_number, weight_text, n AS parsed, CASE WHEN n > 0 THEN n END AS loaded_weight,
                   CASE WHEN trim(weight_text) = '' THEN 0 WHEN n >= 0 THEN n END AS bodyweight_load
            FROM (SELECT *, {DECIMAL.format(t='weight_text')} AS n FROM form)""", FORM),
        "entry_preview": v("exercises", f"""
            SELECT workout_id, exercise_id, set_number, weight_text,
                   CASE WHEN r > 0 AND s > 0 AND (bw OR w > 0) THEN {label('bw', 'coalesce(w, 0)', 'r', 's')} END AS preview
            FROM (SELECT f.*, e.equipment = 'bodyweight' AS bw,
                         CASE WHEN trim(weight_text) = '' THEN 0 ELSE {DECIMAL.format(t='weight_text')} END AS w,
                         try_cast(nullif(reps_text, '') AS DOUBLE) AS r, try_cast(sets_text AS DOUBLE) AS s
                  FROM form f JOIN exercises e USING (exercise_id))""", FORM),
        "log_summary_text": v("messages alias_rows catalog_source", f"""SELECT p.msg_id, {SUMMARY} AS summary
            FROM parsed p JOIN catalog_source c ON c.slug = p.slug WHERE p.is_log""", MESSAGE_SQL, recursive=True),
        "allowed_users": v("goals workouts", """
            SELECT workout_id, user_id, workout_date FROM workouts WHERE user_id IN (
              SELECT user_id FROM goals WHERE status = 'achieved' AND horizon = 'long'
              UNION SELECT user_id + 2 FROM goals WHERE status = 'achieved' AND horizon = 'long')"""),
        "profile_or_fallback": v("profile local_profiles workouts", """
            SELECT u.user_id, coalesce(p.display_name, l.display_name) AS display_name, coalesce(p.goal, l.goal) AS goal,
                   CASE WHEN p.user_id IS NOT NULL THEN 'table' WHEN l.user_id IS NOT NULL THEN 'local' ELSE 'missing' END AS source
            FROM (SELECT user_id FROM events UNION SELECT user_id FROM workouts) u
            LEFT JOIN profile p ON p.user_id = u.user_id LEFT JOIN local_profiles l ON l.user_id = u.user_id"""),
        "local_date": """SELECT event_id, CAST(timezone(['UTC', 'Europe/Moscow', 'America/New_York'][user_id % 3 + 1],
            timezone('UTC', ts)) AS DATE) AS local_date FROM events""",
        "picker_subtitle": v("overview_fixed", f"""
            SELECT user_id, muscle_group, slug, CASE WHEN is_logged_today THEN {label('bw', 'last_weight_kg', 'last_reps', 'last_sets_count')}
              WHEN session_count > 0 THEN session_count || ' в истории' ELSE 'Не в истории' END AS subtitle FROM overview_fixed"""),
        "summary_title": v("summary_rows exercises", f"""
            SELECT r.user_id, e.slug, strftime(workout_date, '%d.%m') || coalesce(' · ' || split_focus, '') AS title,
                   {label("(e.equipment = 'bodyweight')", 'weight_kg', 'reps', 'sets_count')} AS line
            FROM summary_rows r JOIN exercises e USING (exercise_id)"""),
        # joins
        "log_join": v("logged", """SELECT user_id, workout_id, workout_date, slug, name, muscle_group, set_number,
            CAST(weight_kg AS DOUBLE) AS weight_kg, reps FROM logged"""),
        "trained_exercises": v("logged", "SELECT DISTINCT user_id, slug, name, muscle_group FROM logged"),
        "visible_rows": v("workout_sets workouts profile", """
            SELECT workout_id, exercise_id, set_number, reps FROM workout_sets s WHERE EXISTS (
              SELECT 1 FROM workouts w WHERE w.workout_id = s.workout_id AND w.user_id IN (SELECT user_id FROM profile))"""),
        "seed_missing": v("exercises seed_rows", """
            SELECT slug, name, muscle_group FROM exercises
            UNION ALL SELECT * FROM seed_rows WHERE slug NOT IN (SELECT slug FROM exercises)"""),
        "orphan_rows": v(" ".join(dict.fromkeys(t for f in FKS for t in (f[0], f[2]))), " UNION ALL ".join(
            f"SELECT '{c}.{k}' AS foreign_key, count(*) AS orphans FROM {c} x WHERE {k} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {p} y WHERE y.{pk} = x.{k})" for c, k, p, pk in FKS)),
        # aggregations
        "muscle_group_sessions": v("logged", """SELECT user_id, muscle_group, count(DISTINCT workout_date) AS session_count
            FROM logged WHERE muscle_group IS NOT NULL AND muscle_group <> '' GROUP BY ALL"""),
        "exercise_sessions": v("logged", """SELECT user_id, muscle_group, slug, name, count(DISTINCT workout_date) AS session_count
            FROM logged GROUP BY ALL"""),
        "focus_counts": v("hist", "SELECT * FROM focus_rows", FOCUS_COUNTS),
        "max_scalar": v("last_dates", "SELECT * FROM last_dates"),
        "uniform_sets": v("workout_sets", "SELECT workout_id, exercise_id, uniform, sets_count FROM details", DETAILS),
        "all_zero_weight": v("tops", """SELECT user_id, slug, bw AS bodyweight, bool_and(max_weight = 0) AS all_zero,
            bw AND bool_and(max_weight = 0) AS reps_mode FROM tops GROUP BY user_id, slug, bw"""),
        "tonnage_display": v("tonnages", """SELECT user_id, slug, workout_date,
            CAST(floor(CAST(tonnage AS DECIMAL(18,4)) + 0.5) AS BIGINT) AS tonnage_kg FROM tonnages"""),
        # named analytics
        "exercise_progress": v("tops", "SELECT user_id, slug, workout_date, max_weight, reps, sets_count FROM tops"),
        "pinned_exercise_progress": v("tops", """SELECT user_id, slug, workout_date, max_weight, reps, sets_count
            FROM tops WHERE slug = 'ex_7'"""),
        "exercise_records": v("tops tonnages", """
            SELECT w.user_id, w.slug, w.workout_date AS weight_pr_date, w.max_weight AS weight_pr, w.reps AS weight_pr_reps,
                   w.sets_count AS weight_pr_sets, t.workout_date AS tonnage_pr_date, t.tonnage AS tonnage_pr,
                   l.workout_date AS latest_date, l.max_weight AS latest_weight, l.reps AS latest_reps,
                   l.sets_count AS latest_sets, lt.tonnage AS latest_tonnage
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slug ORDER BY max_weight DESC, workout_date) AS rn FROM tops) w
            JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, slug ORDER BY tonnage DESC, workout_date) AS rn FROM tonnages) t
              ON t.user_id = w.user_id AND t.slug = w.slug AND t.rn = 1
            JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, slug ORDER BY workout_date DESC) AS rn FROM tops) l
              ON l.user_id = w.user_id AND l.slug = w.slug AND l.rn = 1
            JOIN tonnages lt ON lt.user_id = l.user_id AND lt.slug = l.slug AND lt.workout_date = l.workout_date
            WHERE w.rn = 1"""),
        "exercise_tonnage": v("tonnages", "SELECT * FROM tonnages"),
        "last_exercise_log": v("last_logs exercises", """SELECT user_id, slug, workout_date, CAST(weight_kg AS DOUBLE) AS weight_kg,
            reps, sets_count FROM last_logs JOIN exercises USING (exercise_id)"""),
        "last_log_capped": v("workouts workout_sets exercises", """
            SELECT n.user_id, e.slug, n.workout_date,
                   CAST(first(s.weight_kg ORDER BY s.set_number, s.weight_kg, s.reps) AS DOUBLE) AS weight_kg,
                   first(s.reps ORDER BY s.set_number, s.weight_kg, s.reps) AS reps, count(*) AS sets_count
            FROM (SELECT DISTINCT ON (c.user_id, s.exercise_id) c.user_id, s.exercise_id, c.workout_date, c.workout_id
                  FROM capped c JOIN workout_sets s USING (workout_id)
                  ORDER BY c.user_id, s.exercise_id, c.workout_date DESC, c.created_at DESC, c.workout_id DESC) n
            JOIN workout_sets s USING (workout_id, exercise_id) JOIN exercises e USING (exercise_id)
            GROUP BY n.user_id, e.slug, n.workout_date""", """
            capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                ORDER BY workout_date DESC, created_at DESC, workout_id DESC) AS n FROM workouts) WHERE n <= 40)"""),
        "last_workout_summary": v("summary_rows exercises", """
            SELECT r.user_id, workout_date, split_focus, e.slug, e.name, e.muscle_group, CAST(weight_kg AS DOUBLE) AS weight_kg,
                   reps, sets_count FROM summary_rows r JOIN exercises e USING (exercise_id)"""),
        "today_overview": v("training_split exercises logged day_logs", TODAY_OUT,
                            f"asked_day AS (SELECT DISTINCT user_id, {AS_OF} AS as_of FROM training_split)," + TODAY),
        "today_overview_last_day": v("training_split exercises logged day_logs last_dates", TODAY_OUT,
                                     "asked_day AS (SELECT user_id, last_date AS as_of FROM last_dates)," + TODAY),
        "muscle_session_overview": v("overview_fixed", "SELECT * EXCLUDE (exercise_id, bw) FROM overview_fixed"),
        "muscle_session_overview_last_day": v("overview day_logs last_dates", """
            SELECT o.* EXCLUDE (exercise_id, bw), d.user_id IS NOT NULL AS is_logged_today, d.weight_kg AS last_weight_kg,
                   d.reps AS last_reps, d.sets_count AS last_sets_count,
                   CAST(row_number() OVER (PARTITION BY o.user_id, o.muscle_group ORDER BY o.session_count DESC, o.name, o.slug) AS INTEGER) AS position
            FROM overview o LEFT JOIN last_dates a ON a.user_id = o.user_id
            LEFT JOIN day_logs d ON d.user_id = o.user_id AND d.exercise_id = o.exercise_id AND d.workout_date = a.last_date"""),
        "session_picker": v("overview_fixed", """
            SELECT user_id, muscle_group, slug, name, session_count,
                   CASE WHEN session_count > 0 AND position <= 3 THEN 'top' ELSE 'more' END AS section, position FROM overview_fixed"""),
        "recent_sessions": v("tops", f"""
            SELECT user_id, slug, position, workout_date, max_weight, reps, sets_count,
                   {point_label('bw', 'max_weight', 'reps', 'sets_count')} AS label
            FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, slug ORDER BY workout_date DESC) AS INTEGER) AS position
                  FROM tops) WHERE position <= 8"""),
        "history_window": v("hist", "SELECT * FROM hist"),
        "chart_domain": v("tops tonnages", """
            SELECT user_id, slug, bw AND bool_and(max_weight = 0) AS reps_mode,
                   CASE WHEN bw AND bool_and(max_weight = 0) THEN CAST(min(p.reps) AS DOUBLE) ELSE min(max_weight) END - 2 AS top_low,
                   CASE WHEN bw AND bool_and(max_weight = 0) THEN CAST(max(p.reps) AS DOUBLE) ELSE max(max_weight) END + 2 AS top_high,
                   min(tonnage) - 5 AS tonnage_low, max(tonnage) + 5 AS tonnage_high
            FROM tops p JOIN tonnages t USING (user_id, slug, workout_date) GROUP BY user_id, slug, bw"""),
        "repeat_last": v("last_logs exercises", f"""
            SELECT user_id, slug, CASE WHEN equipment = 'bodyweight' AND weight_kg = 0 THEN '' ELSE {num('weight_kg')} END AS weight_text,
                   CAST(reps AS VARCHAR) AS reps_text, CAST(sets_count AS VARCHAR) AS sets_text,
                   {general('weight_kg')} || '×' || reps || '×' || sets_count AS button_text
            FROM last_logs JOIN exercises USING (exercise_id)"""),
        "no_history_exercises": v("overview", """SELECT user_id, muscle_group, slug, name FROM overview WHERE session_count = 0"""),
        "newest_workout_per_exercise": v("day_logs", "SELECT * FROM day_logs"),
        # reports
        "set_detail": v("workout_sets", "SELECT workout_id, exercise_id, uniform, detail FROM details", DETAILS),
        "key_lift_progression": v("hist workout_sets exercises catalog_source", "SELECT user_id, slug, sessions, block FROM lifts", BLOCKS),
        "focused_progression": v("hist messages workout_sets exercises alias_rows catalog_source", "SELECT * FROM focused",
                                 RESOLVE.format(src="messages") + "," + BLOCKS + "," + FOCUSED, recursive=True),
        "full_log": v("hist workout_sets exercises catalog_source", "SELECT * FROM log_blocks", BLOCKS),
        "profile_snapshot": v("profile hist workout_sets exercises training_split goals injuries exercise_bans catalog_source",
                              "SELECT * FROM docs", DOCUMENTS),
        "alias_reference": v("catalog_source", f"SELECT slug, {ALIAS_LINE} AS line FROM catalog_source c"),
        "matched_lines": v("messages alias_rows catalog_source", "SELECT * FROM matched",
                           RESOLVE.format(src="messages") + "," + MATCHED, recursive=True),
        "message_context": v("profile hist workout_sets exercises training_split goals injuries exercise_bans catalog_source "
                             "messages alias_rows", """
            SELECT msg_id, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS context_md5 FROM (
              SELECT m.msg_id, CASE WHEN a.text IS NULL AND f.text IS NULL AND d.document IS NULL THEN m.text
                       ELSE '[Fresh data — use for this reply]' || chr(10)
                            || concat_ws(chr(10) || chr(10), a.text, f.text, d.document)
                            || chr(10) || chr(10) || '---' || chr(10) || 'User: ' || m.text END AS c
              FROM messages m LEFT JOIN matched a ON a.msg_id = m.msg_id LEFT JOIN focused f ON f.msg_id = m.msg_id
              LEFT JOIN docs d ON d.user_id = m.user_id)""",
                             RESOLVE.format(src="messages") + "," + DOCUMENTS + "," + MATCHED + "," + FOCUSED, recursive=True),
        "allowed_catalog": v("profile exercises exercise_bans alias_rows", """
            SELECT p.user_id, e.muscle_group, e.slug, e.name FROM profile p CROSS JOIN exercises e
            WHERE NOT EXISTS (SELECT 1 FROM found f JOIN ban_text b USING (msg_id) WHERE b.user_id = p.user_id AND f.slug = e.slug)""",
                             "ban_text AS (SELECT ban_id AS msg_id, user_id, exercise_name AS text FROM exercise_bans WHERE is_active),"
                             + RESOLVE.format(src="ban_text"), recursive=True),
        "next_load": v("tops user_exercises exercises", """
            SELECT l.user_id, l.slug, l.max_weight + CASE WHEN l.reps >= cap THEN 1.0 ELSE 0.0 END AS next_weight_kg,
                   CAST(l.reps + CASE WHEN l.reps >= cap THEN 0 ELSE 1 END AS INTEGER) AS next_reps, l.sets_count AS next_sets
            FROM (SELECT l.*, CASE WHEN u.role = 'accessory' THEN 10 ELSE 8 END AS cap
                  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slug ORDER BY workout_date DESC) AS rn FROM tops) l
                  JOIN exercises e USING (slug)
                  LEFT JOIN user_exercises u ON u.user_id = l.user_id AND u.exercise_id = e.exercise_id WHERE l.rn = 1) l"""),
        # messages
        "normalized_text": v("messages", """SELECT msg_id, replace(lower(text), 'ё', 'е') AS parser_text,
            trim(replace(lower(text), 'ё', 'е')) AS resolver_text FROM messages"""),
        "resolve_exercises": v("messages alias_rows", "SELECT msg_id, position, slug FROM found",
                               RESOLVE.format(src="messages"), recursive=True),
        "parse_numbers": v("messages", "SELECT * FROM nums WHERE weight_kg IS NOT NULL", NUMBERS),
        "parse_date": v("messages", "SELECT * FROM days", DATES),
        "classify_message": v("messages alias_rows", "SELECT msg_id, is_log FROM parsed", MESSAGE_SQL, recursive=True),
        "parsed_log": v("messages alias_rows", """SELECT msg_id, user_id, slug, weight_kg, reps, sets, workout_date, confidence
            FROM parsed WHERE is_log""", MESSAGE_SQL, recursive=True),
        "route_messages": v("messages alias_rows exercises catalog_source", f"""
            SELECT p.msg_id, CASE WHEN NOT p.is_log THEN 'pass_through' WHEN p.confidence = 'medium' THEN 'clarify'
                     WHEN p.reps BETWEEN 1 AND 32767 AND p.sets BETWEEN 1 AND 32767 AND p.weight_kg < 10000
                          AND (p.weight_kg > 0 OR e.equipment = 'bodyweight') THEN 'saved'
                     ELSE 'save_failed' END AS outcome, CASE WHEN p.is_log THEN {SUMMARY} END AS summary
            FROM parsed p LEFT JOIN exercises e ON e.slug = p.slug LEFT JOIN catalog_source c ON c.slug = p.slug""",
                            MESSAGE_SQL, recursive=True),
        "validate_log": v("log_events exercises", """
            SELECT event_id, reason IS NULL AS accepted, reason FROM (
              SELECT event_id, CASE WHEN sets_count <= 0 THEN 'bad_sets' WHEN reps <= 0 THEN 'bad_reps'
                       WHEN weight_kg < 0 THEN 'bad_weight' WHEN slug IS NULL THEN 'unknown_exercise'
                       WHEN weight_kg = 0 AND equipment <> 'bodyweight' THEN 'zero_weight' END AS reason
              FROM log_events LEFT JOIN exercises USING (exercise_id))"""),
        "structured_log": v("log_events catalog_source", f"""
            SELECT entry_id, user_id, p.slug, coalesce(c.canonical, p.slug) AS name, weight_kg, reps, sets, workout_date,
                   'high' AS confidence, coalesce(c.canonical, p.slug) || ' ' || {general('weight_kg')} || '×' || reps || '×' || sets AS raw_text
            FROM (SELECT event_id AS entry_id, user_id, workout_date,
                         'ex_' || (exercise_id + CASE WHEN event_id % 11 = 5 THEN 40 ELSE 0 END) AS slug,
                         CAST(weight_kg AS DOUBLE) AS weight_kg, reps, sets_count AS sets
                  FROM log_events WHERE event_id % 11 NOT IN (3, 7, 9)) p LEFT JOIN catalog_source c ON c.slug = p.slug"""),
        # write path
        "attach_workouts": v("app_events", ATTACH_OUT, replay("app_events", None, True), recursive=True),
        "attach_workouts_bot": v("chat_events", ATTACH_OUT, replay("chat_events", None, False), recursive=True),
        "attach_workouts_existing": v("app_events dated_workouts", ATTACH_OUT,
                                      replay("app_events", "dated_workouts", True), recursive=True),
        "attach_workouts_bot_existing": v("chat_events dated_workouts", ATTACH_OUT,
                                          replay("chat_events", "dated_workouts", False), recursive=True),
        "continue_recent": v("app_events dated_workouts", ATTACH_OUT,
                             replay("app_events", "dated_workouts", True, "2024-01-10"), recursive=True),
        "replace_sets": v("app_events", """
            SELECT workout_key, exercise_id, CAST(unnest(range(1, sets_count + 1)) AS INTEGER) AS set_number,
                   CAST(weight_kg AS DOUBLE) AS weight_kg, reps, replaced
            FROM (SELECT *, row_number() OVER (PARTITION BY workout_key, exercise_id ORDER BY ts DESC, event_id DESC) AS rn,
                         count(*) OVER (PARTITION BY workout_key, exercise_id) > 1 AS replaced FROM attached) WHERE rn = 1""",
                          replay("app_events", None, True), recursive=True),
        "log_receipt": v("app_events", """
            SELECT event_id, workout_key, row_number() OVER (PARTITION BY workout_key, exercise_id ORDER BY ts, event_id) > 1 AS replaced,
                   event_focus AS split_focus FROM attached""", replay("app_events", None, True), recursive=True),
        "upsert_profile": v("profile local_profiles", """
            SELECT coalesce(o.user_id, n.user_id) AS user_id,
                   CASE WHEN o.user_id IS NULL THEN 'new ' || n.display_name ELSE o.display_name END AS display_name,
                   CASE WHEN o.user_id IS NULL THEN n.height_cm + 1 ELSE o.height_cm END AS height_cm,
                   CAST(CASE WHEN n.user_id IS NULL THEN o.weight_kg ELSE n.weight_kg + 1 END AS DOUBLE) AS weight_kg,
                   CASE WHEN o.user_id IS NULL THEN upper(n.body_type) ELSE o.body_type END AS body_type,
                   CASE WHEN n.user_id IS NULL THEN o.goal ELSE lower(n.goal) END AS goal,
                   CASE WHEN n.user_id IS NULL THEN o.notes ELSE n.notes END AS notes,
                   CASE WHEN n.user_id IS NULL THEN o.nutrition ELSE n.nutrition END AS nutrition
            FROM profile o FULL JOIN local_profiles n ON n.user_id = o.user_id"""),
        "seed_plain": v("profile training_split", f"""
            SELECT user_id, day_label, focus, sort_order FROM training_split
            UNION ALL SELECT p.user_id, v.day_label, v.focus, v.sort_order FROM profile p CROSS JOIN {PLAN_ROWS}
            WHERE NOT EXISTS (SELECT 1 FROM training_split t WHERE t.user_id = p.user_id AND t.day_label = v.day_label AND t.focus = v.focus)"""),
        "replace_history": v("workouts dated_workouts profile", """
            SELECT workout_id, user_id, workout_date, split_focus FROM workouts
            WHERE user_id NOT IN (SELECT user_id FROM new_rows)
            UNION ALL SELECT * FROM new_rows""", """
            new_rows AS (SELECT workout_id, user_id, workout_date, split_focus FROM dated_workouts
                         WHERE user_id IN (SELECT user_id FROM profile WHERE goal = 'BUILDING'))"""),
        "table_functions": v("profile tops tonnages last_logs exercises", """
            SELECT p.user_id, x.workout_date, x.max_weight, x.reps, n.tonnage, l.workout_date AS last_date,
                   CAST(l.weight_kg AS DOUBLE) AS last_weight
            FROM profile p JOIN tops x ON x.user_id = p.user_id AND x.slug = 'ex_7'
            JOIN tonnages n ON n.user_id = x.user_id AND n.slug = x.slug AND n.workout_date = x.workout_date
            JOIN last_logs l ON l.user_id = p.user_id AND l.exercise_id = 7"""),
        "replace_stored_history": v("logged profile app_events", """
            SELECT user_id, workout_date, strftime(workout_date, '%Y-%m') AS month, slug, set_number, CAST(weight_kg AS DOUBLE) AS weight_kg, reps
            FROM logged WHERE user_id NOT IN (SELECT user_id FROM profile WHERE goal = 'BUILDING')
            UNION ALL
            SELECT user_id, workout_date, strftime(workout_date, '%Y-%m') AS month, slug,
                   CAST(unnest(range(1, sets_count + 1)) AS INTEGER) AS set_number, CAST(weight_kg AS DOUBLE) AS weight_kg, reps
            FROM (SELECT DISTINCT ON (workout_key, exercise_id) a.*, e.slug FROM attached a JOIN exercises e USING (exercise_id)
                  WHERE a.user_id IN (SELECT user_id FROM profile WHERE goal = 'BUILDING')
                  ORDER BY workout_key, exercise_id, ts DESC, event_id DESC)""", replay("app_events", None, True), recursive=True),
        "cross_join_seed": v("profile exercises", f"""
            SELECT 'baseline|' || p.user_id AS workout_key, p.user_id, e.exercise_id, v.set_number,
                   CAST(v.weight_kg AS DOUBLE) AS weight_kg, v.reps FROM profile p CROSS JOIN {LITERALS} JOIN exercises e USING (slug)"""),
        "cascade_delete": v("all_profiles profile goals injuries exercise_bans training_split user_exercises workouts workout_sets",
            " UNION ALL ".join(
                [f"SELECT '{t}' AS table_name, count(*) AS kept FROM {t} x WHERE {kept}" for t in
                 ("profile", "goals", "injuries", "exercise_bans", "training_split", "user_exercises", "workouts")]
                + [f"""SELECT 'workout_sets', count(*) FROM workout_sets s
                       WHERE EXISTS (SELECT 1 FROM workouts x WHERE x.workout_id = s.workout_id AND {kept})""",
                   f"""SELECT 'user_exercises.split_id is null', count(*) FROM user_exercises x WHERE {kept} AND NOT EXISTS (
                       SELECT 1 FROM training_split y WHERE y.split_id = x.split_id AND y.user_id NOT IN (SELECT user_id FROM gone))"""]),
            "gone AS (SELECT user_id FROM all_profiles WHERE user_id NOT IN (SELECT user_id FROM profile))"),
        "write_log": v("workouts workout_sets", """
            SELECT user_id, workout_id, workout_date, strftime(workout_date, '%Y-%m') AS month, exercise_id, set_number,
                   CAST(weight_kg AS DOUBLE) AS weight_kg, reps FROM workouts JOIN workout_sets USING (workout_id)"""),
        # data quality
        "dup_keys": v(" ".join(UNIQUE), " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, {_key(k)} AS key, count(*) AS n FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1"
            for t, k in UNIQUE.items())),
        "domain_violations": v("goals injuries user_exercises", """
            SELECT 'goals.horizon' AS rule, horizon AS value, count(*) AS n FROM goals WHERE horizon NOT IN ('short', 'medium', 'long') GROUP BY ALL
            UNION ALL SELECT 'goals.status', status, count(*) FROM goals WHERE status NOT IN ('active', 'achieved', 'paused') GROUP BY ALL
            UNION ALL SELECT 'injuries.status', status, count(*) FROM injuries WHERE status NOT IN ('active', 'recovering', 'resolved') GROUP BY ALL
            UNION ALL SELECT 'user_exercises.role', role, count(*) FROM user_exercises WHERE role NOT IN ('base', 'accessory') GROUP BY ALL"""),
        "range_violations": v("workouts workout_sets", """
            SELECT 'workouts.overall_rpe' AS rule, overall_rpe AS value, count(*) AS n FROM workouts WHERE overall_rpe NOT BETWEEN 1 AND 10 GROUP BY ALL
            UNION ALL SELECT 'workout_sets.rpe', rpe, count(*) FROM workout_sets WHERE rpe NOT BETWEEN 1 AND 10 GROUP BY ALL"""),
        "null_violations": v(" ".join(NOT_NULL), " UNION ALL ".join(
            f"SELECT '{t}.{c}' AS column_name, count(*) - count({c}) AS nulls FROM {t}" for t, cs in NOT_NULL.items() for c in cs)),
        "defaults_applied": v("goals", f"""
            SELECT user_id, description, CASE WHEN status = 'paused' THEN 'active' ELSE status END AS status,
                   CASE WHEN sort_order > 2 THEN sort_order ELSE 0 END AS sort_order, TRUE AS is_active,
                   CASE WHEN horizon = 'short' THEN 'accessory' ELSE 'base' END AS role, {AS_OF} AS workout_date FROM goals"""),
        "catalog_drift": v("catalog_source seed_rows exercises", """
            SELECT * FROM (
              SELECT coalesce(d.slug, e.slug) AS slug, CASE WHEN e.slug IS NULL THEN 'only_in_dictionary'
                       WHEN d.slug IS NULL THEN 'only_in_table' WHEN d.canonical IS DISTINCT FROM e.name THEN 'name_differs'
                       WHEN d.muscle_group IS DISTINCT FROM e.muscle_group THEN 'muscle_differs' END AS drift,
                     d.canonical AS dict_name, e.name AS table_name
              FROM catalog_source d FULL JOIN (SELECT * FROM seed_rows
                UNION ALL SELECT 'old_' || slug, name, muscle_group FROM exercises WHERE ord >= 20) e ON e.slug = d.slug)
            WHERE drift IS NOT NULL"""),
        # streaming, as one batch
        "stream_daily_tonnage": v("valid_events", """SELECT workout_date, user_id, slug,
            CAST(sum(weight_kg * reps * sets_count) AS DOUBLE) AS tonnage, count(*) AS logs FROM valid_events GROUP BY ALL"""),
        "stream_last_log": v("valid_events", """
            SELECT user_id, slug, event_id, workout_date, CAST(weight_kg AS DOUBLE) AS weight_kg, reps, sets_count
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slug ORDER BY ts DESC, event_id DESC) AS rn FROM valid_events)
            WHERE rn = 1"""),
        "stream_dedup": "SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events",
        "training_bouts": v("valid_events", """
            SELECT user_id, bout, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended,
                   count(*) AS logs, CAST(sum(weight_kg * reps * sets_count) AS DOUBLE) AS tonnage
            FROM (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS bout
                  FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR
                                       THEN 0 ELSE 1 END AS opens FROM valid_events)) GROUP BY user_id, bout"""),
        # bouts whose gap and lateness have passed at the newest log
        "stream_training_bouts": v("valid_events", """
            SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, strftime(b, '%Y-%m-%d %H:%M:%S') AS ended, logs, tonnage
            FROM (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS logs, CAST(sum(weight_kg * reps * sets_count) AS DOUBLE) AS tonnage
                  FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bout
                        FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR
                                             THEN 0 ELSE 1 END AS opens FROM valid_events)) GROUP BY user_id, bout)
            WHERE b + INTERVAL 6 HOUR <= (SELECT max(ts) FROM valid_events) - INTERVAL 2 DAY"""),
    }
    q["seed_catalog"] = q["seed_missing"]
    q["exercise_progress_stored"] = q["exercise_progress_refreshed"] = q["exercise_progress"]
    q["exercise_tonnage_stored"] = q["exercise_tonnage"]
    q["last_exercise_log_stored"] = q["last_exercise_log"]
    q["stream_ingest"] = q["validate_log"]
    q["stream_upsert"] = q["stream_upsert_batches"] = q["replace_sets"]
    q["stream_last_log_batches"] = q["stream_last_log"]
    return q
