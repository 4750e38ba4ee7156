"""Extraction and composing with recorded answers."""

import json

import pytest
from pyspark.sql import functions as F

from kinspan.operators import compose, extraction, state
from test_operators import ids, make


def talk(spark, n):
    return make(spark, "utterances", [{"id": f"u{i}", "session_id": "s", "seq": i, "speaker": "Rose", "role": ("owner", "interviewer", "unknown")[i % 3], "text": f"Line {i}."} for i in range(n)])


def test_windows_answers_and_resumption(spark):
    rows = extraction.planned(talk(spark, 60), 10, 2)
    assert {r["plan"] for r in rows.collect()} == {"10/2/40"} and rows.select("window").distinct().count() == 5
    done = rows.where("window < 3").select("case_id", "session_id", "plan", "window").distinct()
    assert sorted(r["window"] for r in extraction.outstanding(rows, done).select("window").distinct().collect()) == [3, 4]
    other = done.withColumn("plan", F.lit("60/8/40"))
    assert extraction.outstanding(rows, other).select("window").distinct().count() == 5

    def provider(prompt):
        if prompt.count("\n") + 1 > 7:
            raise extraction.Truncated
        first = prompt[1 : prompt.index("]")]
        return json.dumps({"claims": [{"text": f"About {first}", "kind": "event", "importance": 2, "source_utterance_ids": [first, "nowhere"]}]})

    got = extraction.answers(rows.where("window = 0"), provider).orderBy("part").collect()
    assert [len(r["ids"]) for r in got] == [7, 7] and len(set(got[0]["ids"]) & set(got[1]["ids"])) == 4
    records = extraction.folded(extraction.answers(rows, provider), talk(spark, 60)).collect()
    report = json.loads(next(r["record"] for r in records if r["collection"] == "report"))
    assert report["claims_added"] == 10 and report["dropped_citations"] == ["nowhere"] * 10


def test_a_window_that_cannot_be_halved_fails(spark):
    def provider(prompt):
        raise extraction.Truncated

    with pytest.raises(Exception, match="Truncated"):
        extraction.answers(extraction.planned(talk(spark, 9), 10, 2), provider).collect()


def test_consent_comes_first(spark):
    cases = spark.createDataFrame([("c",), ("d",)], "id string")
    consents = make(spark, "consents", [{"case_id": c, "scope": s, "granted": True} for c in ("c", "d") for s in state.FIRST_CONSENTS if (c, s) != ("d", "ai_processing")])
    u = talk(spark, 3).union(talk(spark, 2).withColumn("case_id", F.lit("d")))
    ok, withheld = extraction.allowed(u, consents, cases, F.lit("2024-01-01").cast("timestamp"))
    assert ok.count() == 3 and withheld.count() == 2


def test_prompts(spark):
    cards = make(spark, "story_cards", [
        {"id": "a", "title": "Late", "year": 0, "strength": 5, "setup": "s", "access": "family", "sensitivity": "routine", "person_ids": ["p2", "gone", "p1"], "quote_ids": ["q"]},
        {"id": "b", "title": "Early", "year": 1931, "year_end": 1933, "approximate": True, "strength": 2, "setup": "s", "conflict": "war", "access": "public", "sensitivity": "tender"},
        {"id": "c", "title": "Kept", "year": 1900, "strength": 5, "access": "operator", "sensitivity": "routine"},
    ])
    people = make(spark, "people", [{"id": "p1", "name": "Ann"}, {"id": "p2", "name": "Ben"}])
    quotes = make(spark, "quotes", [{"id": "q", "text": "well"}, {"id": "z", "text": "no"}])
    cases = spark.createDataFrame([("c", "Rose May", "", "en")], "id string, owner_name string, owner_preferred_name string, language string")
    b = compose.briefs(cards, people, make(spark, "places", []))
    text = {r["id"]: r["brief"] for r in b.collect()}
    assert text["a"] == "[a] Late -- strength 5/5\n  setup: s\n  people: Ben, Ann"
    assert text["b"] == "[b] Early (1931-1933, approximate) -- strength 2/5\n  setup: s\n  conflict: war\n  sensitivity: tender"
    assert ids(compose.quotes_for(quotes, cards)) == ["q"]
    p = compose.direction_prompts(cases, b).first()["prompt"]
    assert p.startswith("A memoir of Rose May is to be made from 2") and p.index("Early") < p.index("Late") and "Kept" not in p
    plan = spark.createDataFrame([("c", 1, "One", "x", ["c", "a"]), ("c", 2, "Two", "y", ["c"])], "case_id string, number int, title string, covers string, story_card_ids array<string>")
    got = compose.chapter_prompts(cases, plan, b, quotes).collect()
    assert [(r["number"], r["provenance"]) for r in got] == [(1, ["a"])] and "- [q] “well”" in got[0]["prompt"]


def test_logs(spark):
    log = spark.createDataFrame([("c", 4, "setup", 10, None)], "case_id string, ord int, stage string, minutes int, at string")
    new = spark.createDataFrame([("c", "drafting", 5, "1"), ("d", "setup", 1, "1"), ("c", "nonsense", 1, "2")], "case_id string, stage string, minutes int, at string")
    out, bad = state.append_labour(log, new)
    assert sorted((r["case_id"], r["ord"]) for r in out.collect()) == [("c", 4), ("c", 5), ("d", 0)] and bad.count() == 1
    q = make(spark, "questions", [{"id": "a", "outcome": "untagged"}, {"id": "b", "outcome": "untagged"}])
    tags = spark.createDataFrame([("c", "a", "scene", 1), ("c", "a", "detail", 2)], "case_id string, id string, outcome string, ord int")
    assert {r["id"]: r["outcome"] for r in state.tag_questions(q, tags).collect()} == {"a": "detail", "b": "untagged"}
