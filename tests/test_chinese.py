"""Scripts, words, names and sounds of Chinese text, by small tables."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinspan.functions import chinese
from kinspan.operators import validators, windows

READINGS = [("王", "wang", 0), ("芳", "fang", 0), ("婷", "ting", 0), ("亭", "ting", 0), ("章", "zhang", 0), ("张", "zhang", 0), ("长", "chang", 0), ("长", "zhang", 1), ("常", "chang", 0), ("乐", "le", 0), ("乐", "yue", 1), ("月", "yue", 0)]
WORDS = [("我们", 900, ""), ("在", 900, "function"), ("我", 900, "function"), ("柳镇", 3, "ns"), ("认识", 300, ""), ("了", 900, "function"), ("陈柳溪", 2, "nr"), ("北京大学", 90, "nt"), ("北京", 400, "ns"), ("大学", 400, ""), ("王", 50, "surname"), ("妈妈", 200, "kin"), ("春", 100, ""), ("先生", 300, "kin"), ("教书", 80, "")]


def test_longest_phrase_first(spark):
    pairs = [("头", "頭"), ("发", "發"), ("头发", "頭髮"), ("头发白", "頭髮白了"), ("理发", "理髮"), ("ab", "X"), ("b", "Y")]
    rng = random.Random(1)
    texts = ["".join(rng.choice("头发白理xab") for _ in range(rng.randrange(30))) for _ in range(300)]

    def naive(t):
        out = ""
        while t:
            hit = max((p for p in pairs if t.startswith(p[0])), key=lambda p: len(p[0]), default=(t[0], t[0]))
            out, t = out + hit[1], t[len(hit[0]) :]
        return out

    convert = chinese.to_script(spark.createDataFrame([*pairs, ("", "?"), ("白", None)], "phrase string, becomes string"))
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [tuple(r) for r in df.select("t", convert(F.col("t")).alias("c")).collect()]
    assert got == [(t, naive(t)) for t in texts] + [(None, None)]


def test_most_probable_cut():
    words = chinese.Words([("ab", 5, ""), ("abc", 2, ""), ("c", 9, ""), ("bc", 7, ""), ("cd", 1, ""), ("d", 3, "")])
    rng = random.Random(2)
    score = lambda cut: sum(math.log(words.freq(w) or 1) - words.total for w in cut)
    for _ in range(200):
        run = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 8)))
        best = -math.inf
        for marks in itertools.product((0, 1), repeat=len(run) - 1):
            cut, last = [], 0
            for i, m in enumerate(marks, 1):
                if m:
                    cut.append(run[last:i])
                    last = i
            cut.append(run[last:])
            if all(len(w) == 1 or w in words.known for w in cut):
                best = max(best, score(cut))
        got = words.cut(run)
        assert "".join(got) == run and score(got) == pytest.approx(best)


def test_names_of_a_text(spark):
    d = spark.createDataFrame(WORDS, chinese.DICTIONARY)
    text = "我们在柳镇认识了陈柳溪。王芳婷在北京大学，春妈妈，我妈妈，教书先生。看《河边旧事》ok"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(chinese.proper_nouns(d)(F.col("t")).alias("n"), chinese.segmented(d)(F.col("t")).alias("w")).collect()
    assert [tuple(x) for x in row[0]["n"]] == [("柳镇", "place"), ("陈柳溪", "person"), ("王芳婷", "person"), ("北京大学", "organisation"), ("春妈妈", "person"), ("河边旧事", "name")]
    assert "".join(row[0]["w"]) == text and row[0]["w"][:4] == ["我们", "在", "柳镇", "认识"] and row[1]["n"] is None
    assert chinese.Words([]).cut("柳镇") == ["柳", "镇"]


def test_names_that_sound_alike(spark):
    r = spark.createDataFrame(READINGS, "char string, reading string, ord int")
    rows = [("c", "1", "王芳婷", 0), ("c", "2", "王芳亭", 1), ("c", "3", "章常", 2), ("c", "4", "张长", 3), ("c", "5", "Ann", 4), ("d", "6", "王芳亭", 0), ("c", "7", "王月", 5), ("c", "8", "王乐", 6), ("c", "9", "王婷乐", 7)]
    got = {(x["other_id"], x["id"]): x["signal"] for x in validators.name_pairs(spark.createDataFrame(rows, "case_id string, id string, name string, at int"), r).collect()}
    assert got == {k: f"same pronunciation ({s}), different characters -- probably one name misheard" for k, s in {("1", "2"): "wang fang ting", ("3", "4"): "zhang chang", ("7", "8"): "wang yue"}.items()}
    without = validators.name_pairs(spark.createDataFrame(rows, "case_id string, id string, name string, at int")).collect()
    assert [(x["other_id"], x["id"], x["signal"]) for x in without] == [("1", "2", "same surname, one character different")]
    people = spark.createDataFrame([(*x, None) for x in rows], "case_id string, id string, name string, ord int, aliases array<string>")
    assert validators.names(people, r).count() == 3


def test_checklist_folds_what_sounds_alike(spark):
    d = spark.createDataFrame([*WORDS, ("王芳婷", 2, "nr"), ("王芳亭", 2, "nr")], chinese.DICTIONARY)
    r = spark.createDataFrame(READINGS, "char string, reading string, ord int")
    turns = spark.createDataFrame([("r", 0, 0.0, 4.0, "我们认识了王芳婷，一九五七年。"), ("r", 1, 5.0, 9.0, "王芳亭在柳镇。")], "recording_id string, ord int, start double, end double, text string")
    got = {x["term"]: (x["kind"], x["count"], x["heard_also"]) for x in windows.checklist(turns, nouns=chinese.proper_nouns(d), readings=r).collect()}
    assert got == {"王芳婷": ("person", 2, ["王芳亭"]), "柳镇": ("place", 1, []), "一九五七年": ("date", 1, [])}


def test_a_table_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(chinese, "MOST", 3)
    with pytest.raises(ValueError, match="too large"):
        chinese.segmented(spark.createDataFrame(WORDS, chinese.DICTIONARY))
