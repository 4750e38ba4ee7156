"""Extraction into cases that are there, with runs that end half-way."""

import json

import pytest
from pyspark.sql import functions as F

from kinspan.operators import extraction, state
from test_operators import make

NOW = "2024-01-01"


def case(spark, n=30, **more):
    u = [{"id": f"u{i}", "session_id": "s", "seq": i, "speaker": "Rose", "role": "owner", "text": f"Line number {i} is told here.", "access": "operator", "sensitivity": "routine"} for i in range(n)]
    consents = [{"scope": x, "granted": True} for x in state.FIRST_CONSENTS]
    t = {name: make(spark, name, more.get(name, [])) for name in ("people", "places", "claims", "quotes", "story_cards")}
    cases = spark.createDataFrame([("c", "Rose May", "Rose")], "id string, owner_name string, owner_preferred_name string")
    return {**t, "cases": cases, "utterances": make(spark, "utterances", u), "sessions": make(spark, "sessions", [{"id": "s"}]), "consents": make(spark, "consents", consents)}


def provider(folder, fail=()):
    """Answers from the lines asked about, and leaves a file for each question."""

    def answer(prompt):
        ids = [line[1 : line.index("]")] for line in prompt.split("\n")]
        with open(f"{folder}/{ids[0]}", "a") as f:
            f.write("x")
        if ids[0] in fail:
            raise ValueError("the service is down")
        claims = [{"text": "The story owner was there.", "kind": "event", "importance": len(ids), "source_utterance_ids": [ids[0]]}]
        card = {"title": "By the river", "source_utterance_ids": ids[:2], "strength": 4, "setup": "water", "people": ["Ann"], "sensitivity": "restricted", "quotes": [{"text": f"line number {ids[0][1:]} is told", "source_utterance_id": ids[0]}]}
        return json.dumps({"claims": claims, "people": [{"name": "ann", "relationship": "sister", "source_utterance_ids": [ids[1]]}], "story_cards": [card]})

    return answer


def asked(folder):
    return {p.name: len(p.read_text()) for p in folder.iterdir()}


def test_a_run_that_fails_resumes_without_asking_twice(spark, tmp_path):
    seen, log = tmp_path / "seen", str(tmp_path / "log")
    seen.mkdir()
    t = case(spark)
    now = F.lit(NOW).cast("timestamp")
    with pytest.raises(extraction.Unanswered, match="1 of 4 .*the service is down"):
        extraction.extract(t, provider(str(seen), fail=("u16",)), log, now, 10, 2)
    assert asked(seen) == {"u0": 1, "u8": 1, "u16": 1, "u24": 1}
    assert sorted(r["window"] for r in extraction.read_log(spark, log).collect()) == [0, 1, 3]
    out, records = extraction.extract(t, provider(str(seen)), log, now, 10, 2)
    assert asked(seen) == {"u0": 1, "u8": 1, "u16": 2, "u24": 1}
    s = out["sessions"].first()
    assert s["extract_plan"] == "10/2/30" and s["extract_windows_done"] == 4 and s["extracted_at"] is not None
    claim = out["claims"].first()
    assert claim["text"] == "Rose was there." and [x["ref_id"] for x in claim["sources"]] == ["u0", "u8", "u16", "u24"]
    assert out["quotes"].count() == 4 and out["story_cards"].count() == 4 and out["people"].count() == 1
    # saved and run again: nothing is asked, nothing folded
    again, records = extraction.extract(out, provider(str(seen), fail=("u0",)), log, now, 10, 2)
    assert records.isEmpty() and again["claims"].count() == 1 and again["sessions"].first() == s


def test_only_windows_without_a_gap_are_folded(spark, tmp_path):
    seen, log = tmp_path / "seen", str(tmp_path / "log")
    seen.mkdir()
    t = case(spark)
    rows = extraction.planned(t["utterances"], 10, 2)
    extraction.ask(rows.where("window <> 1"), provider(str(seen)), log)
    at = extraction.progress(rows, extraction.read_log(spark, log), t["sessions"]).first()
    assert (at["done"], at["upto"], at["total"]) == (0, 1, 4)
    part = make(spark, "sessions", [{"id": "s", "extract_plan": "10/2/30", "extract_windows_done": 1}])
    extraction.ask(rows, provider(str(seen)), log)
    at = extraction.progress(rows, extraction.read_log(spark, log), part).first()
    assert (at["done"], at["upto"]) == (1, 4) and asked(seen) == {"u0": 1, "u8": 1, "u16": 1, "u24": 1}
    other = part.withColumn("extract_plan", F.lit("60/8/30"))
    assert extraction.progress(rows, extraction.read_log(spark, log), other).first()["done"] == 0


def test_a_fold_adds_to_what_is_there(spark, tmp_path):
    cite = lambda *x: [{"kind": "utterance", "ref_id": i, "locator": "00:01"} for i in x]
    seen = tmp_path / "seen"
    seen.mkdir()
    t = case(
        spark, 10, people=[{"id": "p1", "name": "Ann", "aliases": ["Annie"], "birth_year": 1931, "sources": cite("u9")}],
        claims=[{"id": "k1", "text": "Rose was there", "kind": "event", "status": "confirmed_by_family", "confirmed_by": "Ben", "importance": 2, "sources": cite("u7")}],
        story_cards=[{"id": "d1", "title": "River", "strength": 5, "access": "family", "notes": "mine", "sources": [*cite("u0", "u1"), {"kind": "artifact", "ref_id": "a1"}]}],
    )
    out, records = extraction.extract(t, provider(str(seen)), str(tmp_path / "log"), F.lit(NOW).cast("timestamp"), 10, 2)
    claim, card, person = (out[n].first() for n in ("claims", "story_cards", "people"))
    assert out["claims"].count() == out["story_cards"].count() == out["people"].count() == 1
    assert (claim["id"], claim["importance"], claim["status"], claim["confirmed_by"]) == ("k1", 10, "confirmed_by_family", "Ben")
    assert [(x["ref_id"], x["locator"]) for x in claim["sources"]] == [("u7", "00:01"), ("u0", None)]
    assert (card["id"], card["title"], card["strength"], card["access"], card["notes"], card["sensitivity"]) == ("d1", "River", 5, "family", "mine", "restricted")
    assert [x["ref_id"] for x in card["sources"]] == ["u0", "u1", "a1"] and card["claim_ids"] == ["k1"] and len(card["quote_ids"]) == 1
    assert (person["id"], person["birth_year"], person["relationship"]) == ("p1", 1931, "sister")
    assert {r["id"] for r in out["utterances"].where("sensitivity = 'restricted'").collect()} == {"u0", "u1"}
    assert out["quotes"].first()["source"]["ref_id"] == "u0"
    withheld = {**t, "consents": t["consents"].limit(0)}
    out, records = extraction.extract(withheld, provider(str(seen)), str(tmp_path / "log2"), F.lit(NOW).cast("timestamp"), 10, 2)
    assert records.isEmpty() and out["sessions"].first()["extract_plan"] is None and asked(seen) == {"u0": 1}
