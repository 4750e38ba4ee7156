"""Turns and speakers against the rules applied to one segment after the other, at once and as they come in."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinspan.functions import text
from kinspan.operators import windows

SEGMENTS = "recording_id string, ord int, start double, end double, text string"


def recordings(seed, words, n=60):
    rng, rows = random.Random(seed), []
    for r in range(6):
        at = 0.0
        for i in range(n if r else 3):
            start = at + rng.choice([0.0, 0.1, 0.3, 0.31, 2.0])
            at = start + rng.choice([0.5, 1.0])
            rows.append((f"r{r}", i, start, at, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 40])))))
    return rows


def judged(t):
    """(units, ends a sentence) of a text, read from the library's fixed values."""
    n = len(re.findall(f"[{text.CJK}]", t)) + len(re.findall(text.LATIN_WORD, re.sub(f"[{text.CJK}]", " ", t)))
    return n, bool(re.search(f"[{text.ENDS}]+[{text.CLOSERS}]*$", t.strip()))


def one_by_one(rows, chinese):
    cap, joiner = (windows.CAP_ZH, "") if chinese else (windows.CAP, " ")
    turns = {}
    for rec, _, start, end, t in sorted(rows, key=lambda r: r[:2]):
        t, own = t.strip(), turns.setdefault(rec, [])
        if not t:
            continue
        n, ends = judged(own[-1][2]) if own else (0, True)
        if own and start - own[-1][1] <= windows.GAP and n < cap and (not ends or (not chinese and t[0].islower())):
            own[-1] = (own[-1][0], end, f"{own[-1][2]}{joiner}{t}".strip())
        else:
            own.append((start, end, t))
    return {k: v for k, v in turns.items() if v}


def collected(df):
    out = {}
    for r in df.orderBy("recording_id", "ord").collect():
        assert r["ord"] == len(out.setdefault(r["recording_id"], []))
        out[r["recording_id"]].append((r["start"], r["end"], r["text"]))
    return out


@pytest.mark.parametrize("chinese, words", [(False, ["So", "we", "went.", "home", "Mr.", "\"", "x!”", "?"]), (True, ["我们", "去了。", "」", "abc", "d'", "'e", "”", "河边"])])
def test_turns_equal_one_by_one_and_live(spark, tmp_path, chinese, words):
    rows = recordings(5, words, 30)
    want = one_by_one(rows, chinese)
    df = spark.createDataFrame(rows, SEGMENTS)
    assert collected(windows.assemble_turns(df.repartition(3), chinese)) == want
    folder = str(tmp_path / "in")
    for low in range(0, 30, 16):  # as batches of a stream, and at last the end of each recording
        df.where(f"ord >= {low} and ord < {low + 16}").coalesce(1).write.mode("append").parquet(folder)
    df.select("recording_id").distinct().selectExpr("recording_id", "99 ord", "0D start", "0D end", "cast(null as string) text").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"live_{chinese}".lower()
    q = windows.live_turns(stream, chinese, wait=None).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert collected(spark.table(name)) == want


def test_speakers_equal_one_by_one(spark):
    rng = random.Random(8)
    words = ["where was it?", "what a day it was", "so we went on", "who", "and then", "no?", "did he " + "go " * 30, "a " * 12]
    rows = []
    for r in range(8):
        at = 0.0
        for i in range(rng.choice([1, 2, 40])):
            start = at + rng.choice([0.0, 0.2, 0.3, 1.0])
            at = start + 1
            rows.append((f"r{r}", i, start, at, rng.choice(words)))
    q = spark.createDataFrame([(w,) for w in words], "text string").select("text", text.looks_like_question(F.col("text"), F.lit(False)))
    asking = dict(map(tuple, q.collect()))
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key)
        n = [judged(r[4])[0] for r in own]
        limit, asks = min(2 * max(10, sorted(n)[len(n) // 2]), 25), []
        for i, r in enumerate(own):
            breath = i > 0 and not asks[-1] and r[2] - own[i - 1][3] < windows.BREATH
            asks.append(asking[r[4]] and n[i] <= limit and not breath)
        for i, r in enumerate(own):
            if i and asks[i] and asks[i - 1] and not r[4].strip().endswith("?"):
                asks[i] = False
        want.update({(key, r[1]): "Op" if a else "Rose" for r, a in zip(own, asks)})
    got = windows.guess_speakers(spark.createDataFrame(rows, SEGMENTS), "Rose", "Op").collect()
    assert {(r["recording_id"], r["ord"]): r["speaker"] for r in got} == want and set(want.values()) == {"Op", "Rose"}


def test_edges(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0, None), ("a", 1, 1.0, 2.0, "  "), (None, 0, 0.0, 1.0, "x"), ("b", 0, None, None, "x"), ("b", 1, 0.0, 1.0, "y")], SEGMENTS)
    assert [tuple(r) for r in windows.assemble_turns(df.where("recording_id is null or recording_id = 'a'")).collect()] == []
    assert windows.assemble_turns(df.limit(0)).isEmpty()
