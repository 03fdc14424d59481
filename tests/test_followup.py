"""Follow-up questions and rules from files."""

import json

from skein.operators import followup
from skein.sources import rules


def test_questions_are_rewritten_by_what_was_said(spark):
    turns = spark.createDataFrame([(1, 0, "user", "who was Kabir"), (1, 1, "assistant", "x" * 500), (1, 2, "user", "and"), (1, 3, "assistant", " "), (2, 0, "user", "old"), (3, 0, "user", None)], "conversation_id long, turn_index long, role string, text string")
    q = spark.createDataFrame([(10, 1, "his songs"), (11, 2, "more"), (12, 3, "no turns"), (13, 4, "unknown")], "query_id long, conversation_id long, text string")
    seen = {r.query_id: r.rewritten for r in followup.standalone(q, turns, lambda p: f' "{p.count("x")} {"Kabir" in p} {p.count("user: ")}" ').collect()}
    assert seen == {10: "400 True 2", 11: "0 False 1", 12: "no turns", 13: "unknown"}
    assert {r.rewritten for r in followup.standalone(q, turns, lambda p: "  ").collect()} == {"his songs", "more", "no turns", "unknown"}
    assert {r.rewritten for r in followup.standalone(q, turns).collect()} == {"his songs", "more", "no turns", "unknown"}


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"loanword_tokens": {"a": "b"}, "hallucination_tokens": ["x y"], "loop_keep": 4}))
    got = rules.read_rules(spark, str(tmp_path / "r.json"))
    assert (got.loanwords, got.natives, got.spellings, got.heads, got.tails, got.loop_run, got.loop_keep) == ({"a": "b"}, {}, {}, ["x y"], [], rules.LOOP_RUN, 4)
