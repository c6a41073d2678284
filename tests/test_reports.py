"""What is added to a chat message, and how it gets there."""

import re

import pytest

from conftest import rows
from liftlake.operators import reports
from liftlake.sources.catalog import CATALOG_SCHEMA

EX = [(1, "bench", "Bench", "chest", "barbell"), (2, "dip", "Dip", "chest", "bodyweight"), (3, "row", "Row", "back", "barbell")]
PROFILE = ("user_id bigint, display_name string, height_cm int, weight_kg decimal(5,2), body_type string, goal string, notes string, "
           "nutrition map<string,string>")


@pytest.fixture
def chat(make, spark):
    """Users 901 (registered, with a log), 902 (a log only), 903 (registered only), 904 (neither) and 905 (registered twice)."""
    profile = [(u, f"name {u} {n}", 180, None, None, None, None, None) for u, n in ((901, 1), (903, 1), (905, 1), (905, 2))]
    t = make([(1, 901, "2026-01-05", "Chest"), (2, 901, "2026-01-07", None), (3, 902, "2026-01-06", "Chest"), (4, 901, "2026-01-08", "Rest")],
             [(1, 1, 1, 60.0, 8), (1, 1, 2, 60.0, 8), (1, 2, 1, 0.0, 10), (2, 1, 1, 62.5, 6), (2, 1, 2, 50.0, 9), (3, 2, 1, 5.0, 7)], EX,
             catalog_source=spark.createDataFrame(
                 [("bench", "Bench", "chest", ["жим"], 1), ("dip", "Dip", "chest", [], 0), ("row", "Row", "back", [], 2)], CATALOG_SCHEMA),
             profile=spark.createDataFrame(profile, PROFILE))
    texts = ["dip и жим 60x8", "жим", "row", "привет"]
    messages = spark.createDataFrame(
        [(u * 10 + i, u, x) for u in (901, 902, 903, 904, 905) for i, x in enumerate(texts)] + [(1, None, "жим"), (2, 901, None), (3, 904, None)],
        "msg_id bigint, user_id bigint, text string")
    return t, messages


NAMES = {"bench": "Bench", "dip": "Dip", "row": "Row"}
NAMED = {"dip и жим 60x8": ["dip", "bench"], "жим": ["bench"], "row": ["row"]}
BLOCKS = {
    901: {"bench": "**Bench:**\n  - 2026-01-05 (Chest): 60.0 kg × 8 × 2\n  - 2026-01-07 (): 50.0×9, 62.5×6\n",
          "dip": "**Dip:**\n  - 2026-01-05 (Chest): 0.0 kg × 10 × 1\n"},
    902: {"dip": "**Dip:**\n  - 2026-01-06 (Chest): 5.0 kg × 7 × 1\n"},
}


def expected(user, text, document):
    if text is None:
        return None
    slugs = NAMED.get(text, [])
    parts = []
    if slugs:
        lines = [f"- User likely means: **{NAMES[s]}** (slug: `{s}`)" for s in slugs]
        parts.append("\n".join([reports.MATCH_HEADER, *lines, "", reports.MATCH_FOOTER]))
    held = [BLOCKS.get(user, {}).get(s) for s in slugs]
    if any(held):
        parts.append(reports.FOCUSED_HEADER + "\n" + "\n".join(b for b in held if b))
    if document is not None:
        parts.append(document)
    return f"{reports.CONTEXT_HEADER}\n" + "\n\n".join(parts) + f"\n\n---\nUser: {text}" if parts else text


def test_context_of_each_kind_of_user(chat):
    t, messages = chat
    documents = {}
    for r in reports.profile_snapshot(t).collect():
        documents.setdefault(r["user_id"], []).append(r["document"])
    assert {u: len(d) for u, d in documents.items()} == {901: 1, 903: 1, 905: 2}
    assert BLOCKS[901]["dip"] + "\n" + BLOCKS[901]["bench"] in documents[901][0]  # in catalog order
    want = sorted(((m["msg_id"], c, None if c is None else len(c)) for m in messages.collect() for c in (
        expected(m["user_id"], m["text"], d) for d in documents.get(m["user_id"], [None]))), key=repr)
    assert rows(reports.message_context(t, messages), "msg_id", "context", "n_chars") == want


def test_documents_go_from_the_join_into_the_texts(chat):
    """Between the join with the documents and the texts nothing has the joined rows written out, as functions on arrays would."""
    t, messages = chat
    plan = reports.message_context(t, messages)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join LeftOuter")]
    assert above.count("Project [") == 1 and not re.search(r"lambda|element_at", above)


def test_progressions_are_made_once(chat, monkeypatch):
    t, messages = chat
    made, real = [], reports.key_lift_progression
    monkeypatch.setattr(reports, "key_lift_progression", lambda *a, **b: made.append(1) or real(*a, **b))
    reports.message_context(t, messages)
    assert len(made) == 1
