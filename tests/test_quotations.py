"""Quotations found by joins on runs against the sequence matcher on every line."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kinspan.functions import fuzzy
from kinspan.operators import quotations, validators
from kinspan.plans import interview_queries

LINES = "case_id string, session_id string, seq int, line string"


def changed(rng, s, n):
    for _ in range(n):
        i = rng.randrange(max(1, len(s)))
        s = rng.choice([s[:i] + rng.choice("abc") + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + rng.choice("abc") + s[i:]])
    return s


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz我你他"])
def test_equals_every_line(spark, letters):
    rng = random.Random(len(letters))
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    lines = [(str(c), str(s), i, text(rng.choice([0, 2, 9, 30, 90, 200]))) for c in range(3) for s in range(2) for i in range(9)]
    corpus = {c: "".join(x[3] for x in lines if x[0] == c) for c in "012"}
    needles = set()
    for _ in range(70):
        c = rng.choice("012")
        at, n = rng.randrange(len(corpus[c]) - 2), rng.choice([1, 2, 3, 5, 8, 13, 14, 26, 50, 130, 400])
        s = corpus[c][at : at + n]
        needles.add((rng.choice([c, c, c, "9"]), changed(rng, s, rng.choice([0, 0, 1, 1, 2, max(1, n // 20), n // 9])) or "a"))
    df = spark.createDataFrame(lines, LINES)
    asked = spark.createDataFrame(sorted(needles), "case_id string, needle string")
    assert {tuple(r) for r in quotations.verbatim(asked, df).collect()} == {(c, s) for c, s in needles if s in corpus.get(c, "")}
    best = {(c, s): max((fuzzy.partial(s, x[3]) for x in lines if x[0] == c), default=0.0) for c, s in needles}
    got = {(r[0], r[1]): r[2] for r in quotations.nearest(asked, df).collect()}
    fits = {k: v for k, v in best.items() if v >= fuzzy.FIDELITY and len(k[1]) >= quotations.Q}
    assert fits and {k: v for k, v in got.items() if v >= fuzzy.FIDELITY} == pytest.approx(fits)
    assert all(v <= best[k] + 1e-9 for k, v in got.items())


def test_blocks_hold_every_passage(spark):
    rng = random.Random(3)
    lines = [("c", f"s{s}", i, "".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 7, 900, 5000])))) for s in range(3) for i in range(6)]
    whole = "".join(x[3] for x in lines)
    parts = {r["block"]: r["text"] for r in quotations.blocks(spark.createDataFrame(lines, LINES)).collect()}
    size = quotations.BLOCK
    assert parts == {b: whole[b * size : (b + 1) * size + quotations.LONGEST] for b in range(-(-len(whole) // size))}


def test_findings_of_conversations(spark, sf):
    """The registered query against every line of the case."""
    said = interview_queries.interviews(spark, sf)
    lines, corpus = {}, {}
    for r in validators.transcript_lines(said).orderBy("session_id", "seq").collect():
        lines.setdefault(r["case_id"], []).append(r["line"])
        corpus[r["case_id"]] = corpus.get(r["case_id"], "") + r["line"]
    spans = validators.quoted_passages(interview_queries.drafts(said), interview_queries._cases(said)).collect()
    want = sorted(
        (s["case_id"], s["span"][:90]) for s in spans if s["needle"] not in corpus[s["case_id"]] and max(fuzzy.partial(s["needle"], x) for x in lines[s["case_id"]]) < fuzzy.FIDELITY
    )
    got = interview_queries.draft_quotes(spark, sf).select("case_id", "detail").collect()
    assert 0 < len(want) < len(spans) and sorted(map(tuple, got)) == want


def test_matching_is_the_sequence_matchers():
    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.choice(["ab", "abcd", "etaoinshrdlu我你"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 9, 60, 130]))) for _ in range(2))
        want = SequenceMatcher(None, a, b, autojunk=False)
        pairs = lambda blocks: {(i + k, j + k) for i, j, n in blocks for k in range(n)}
        assert pairs(fuzzy.matching(a, b)) == pairs(want.get_matching_blocks()) and fuzzy.plain_ratio(a, b) == want.ratio()


def test_runs_of_a_passage_are_not_carried_along(spark):
    """A row for each run of a passage, and none of them with all its runs."""
    asked = spark.createDataFrame([("c", "abcdefgh")], "case_id string, needle string")
    ranked = quotations._ranked(asked, spark.createDataFrame([("abc",)], "run string"))
    assert ranked.count() == 6 and not any(kind.startswith("array") for _, kind in ranked.dtypes)


def test_no_run_of_a_passage_or_line_is_shuffled(spark):
    """No row is made of each run, and few pairs are matched: a line that shares most runs, but none near each other, is no fit."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    lines = [("c", "s", i, text(300)) for i in range(40)]
    asked = [("c", text(60)) for _ in range(50)] + [("c", lines[i][3][100:130] + "x" + lines[i][3][131:160]) for i in range(20)]
    df, needles = spark.createDataFrame(lines, LINES), spark.createDataFrame(asked, "case_id string, needle string")
    assert "Generate" not in quotations.nearest(needles, df)._jdf.queryExecution().executedPlan().toString()
    index = quotations._alike(fuzzy.FIDELITY)([x[3] for x in lines])
    found = index([x[1] for x in asked])
    assert [(x, y) for x, y, fits in zip(found["needle"], found["line"], found["fits"]) if fits] == [(asked[50 + i][1], lines[i][3]) for i in range(20)]
    assert len(found["needle"]) == len(asked)


@pytest.mark.parametrize("chunk", [500, 3000])
def test_chunks_of_a_case(spark, monkeypatch, chunk):
    """A case larger than one index, with lines told twice, gives what one index gives."""
    rng = random.Random(chunk)
    lines = [("c", str(s), i, "".join(rng.choice("abcdefgh我") for _ in range(rng.choice([1, 40, 300])))) for s in range(3) for i in range(12)]
    lines += [("c", "9", i, x[3]) for i, x in enumerate(lines[:5])]
    whole = "".join(x[3] for x in lines)
    asked = sorted({changed(rng, whole[at : at + 40], k % 3) for k, at in enumerate(rng.sample(range(len(whole) - 40), 60))} | {"zzzz", "ab"})
    df, needles = spark.createDataFrame(lines, LINES), spark.createDataFrame([("c", x) for x in asked], "case_id string, needle string")
    look = lambda f: sorted(map(tuple, f(needles, df).collect()))
    want = look(quotations.verbatim), look(quotations.nearest)
    monkeypatch.setattr(quotations, "CHUNK", chunk)
    assert (look(quotations.verbatim), look(quotations.nearest)) == want and [x[1] for x in want[0]] == [x for x in asked if x in whole]


def test_edges(spark):
    cases = spark.createDataFrame([("c", "en"), ("z", "zh")], "id string, language string")
    u = spark.createDataFrame([("c", "s", 1, "We walked to the"), ("c", "s", 2, "river in the morning."), ("c", "s", 3, None), ("z", "s", 1, "我们一起走到了河边看日出")], "case_id string, session_id string, seq int, text string")
    said = lambda *rows: spark.createDataFrame(list(rows), "case_id string, text string")
    got = validators.draft_quotes(said(("c", '"to the river, in THE morning" "We flew to the far moon" "We flew to the far moon" "too short"'), ("c", None), ("z", "「我们一起走到了河边」「他们坐船去了北京的学校」"), ("x", '"no such case is here at all"')), u, cases)
    assert sorted((r["case_id"], r["detail"]) for r in got.collect()) == [("c", "We flew to the far moon")] * 2 + [("x", "no such case is here at all"), ("z", "他们坐船去了北京的学校")]
    assert validators.draft_quotes(said(("c", "nothing quoted")), u, cases).isEmpty()
    assert validators.draft_quotes(said(("c", '"we flew to the far moon"')), u.limit(0), cases).select(F.col("message")).first()[0].endswith("(best match 0.00)")
