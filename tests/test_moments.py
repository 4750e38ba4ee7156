"""Cards grouped by joins against the rule applied to one card after the other."""

import random

import pytest
from pyspark.sql import functions as F

from kinspan.operators import merge
from kinspan.plans import interview_queries

CARDS = "case_id string, ord int, title string, strength int, sources array<string>, existing boolean"


def one_by_one(rows):
    out = {}
    for case in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == case), key=lambda r: r[1])
        cards = [{"place": (merge._BEFORE if r[5] else 0, r[1]), "title": r[2] or "", "strength": r[3] or 0, "sources": [s for s in dict.fromkeys(r[4] or []) if s]} for r in own]
        for group in merge.moments(cards):
            out.update({(case, c["place"][1]): group[0]["place"][1] for c in group})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for case in "abc":
        at = 0
        for i in range(45):
            at = max(0, at + rng.choice([-2, 0, 1, 1, 2]))
            n = rng.choice([0, 1, 2, 3, 5]) if case != "c" else rng.choice([1, 2])
            rows.append((case, i, rng.choice(["River", "the river!", "Home", "", None]), rng.choice([1, 3, 3, 5, None]), [f"u{at + rng.randrange(5 if case != 'c' else 2)}" for _ in range(n)], i < 6 and rng.random() < 0.7))
    rows = sorted(rows, key=lambda r: (not r[5], r[1]))
    rows = [(r[0], i, *r[2:]) for i, r in enumerate(rows)]  # records that are there come first
    got = {(r["case_id"], r["ord"]): r["moment"] for r in merge.moments_by_joins(spark.createDataFrame(rows, CARDS)).collect()}
    want = one_by_one(rows)
    assert got == want and len(set(want.values())) < len(want)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1, "x", 1, None, None), ("a", 2, "x", 1, ["u"], None), ("a", 3, "X.", 1, ["u", "u", None], None), (None, 4, "x", 1, ["u"], None)], CARDS)
    assert {r["ord"]: r["moment"] for r in merge.moments_by_joins(df.where("case_id is not null").drop("existing")).collect()} == {1: 1, 2: 2, 3: 2}
    assert merge.moments_by_joins(df.limit(0)).isEmpty()


def test_conversations(spark, sf):
    cards = interview_queries.scene_cards(interview_queries.interviews(spark, sf)).withColumn("existing", F.lit(False)).select("case_id", "ord", "title", "strength", "sources", "existing")
    want = one_by_one([tuple(r) for r in cards.collect()])
    got = {(r["case_id"], r["ord"]): r["moment"] for r in interview_queries.scene_moments(spark, sf).collect()}
    assert got == want and len(set(want.values())) < len(want)
