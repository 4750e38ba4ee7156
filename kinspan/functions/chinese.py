"""Chinese text by tables that the caller supplies: scripts, words and their tags, and how characters sound.

Phrase tables and dictionaries are of a fixed size, whatever the texts' is: they are counted, sent to all tasks up to MOST
entries and refused beyond. Readings are joined, as the names that they are asked of are a table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspan.functions.text import CJK, key_of

#: Entries of a table that is sent to all tasks.
MOST = 1_000_000
DICTIONARY = "word string, freq long, tag string"
#: A dictionary word of a person is no longer; one of an organisation no shorter and rarer; what stands before a kinship word is rarer.
PERSON, ORGANISATION, COMMON, RARE = 4, 3, 200, 50
_RUN, _TITLE = re.compile(f"[{CJK}]+"), re.compile("《([^》]{1,30})》")


def _sent(table: DataFrame, *columns: str):
    n = table.count()
    if n > MOST:
        raise ValueError(f"a table of {n} entries is too large to be sent to all tasks; {MOST} can be")
    return table.sparkSession.sparkContext.broadcast([tuple(r) for r in table.select(*columns).collect()])


# ---- scripts --------------------------------------------------------------------------------------------------------


def trie(pairs: list[tuple[str, str]]) -> dict:
    """Nested dictionaries by character; what a phrase becomes stands under the empty string. The first of equal phrases counts."""
    root: dict = {}
    for phrase, becomes in pairs:
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        if node is not root:
            node.setdefault("", becomes)
    return root


def replaced(text: str, root: dict) -> str:
    """The text with the longest phrase at each place replaced, from left to right."""
    out, i = [], 0
    while i < len(text):
        node, j, end, new = root, i, i + 1, text[i]
        while j < len(text) and text[j] in node:
            node, j = node[text[j]], j + 1
            if "" in node:
                end, new = j, node[""]
        out.append(new)
        i = end
    return "".join(out)


def to_script(phrases: DataFrame) -> Callable[[Column], Column]:
    """A function of a text that puts it into another script by the phrases (phrase, becomes), longest first."""
    sent = _sent(phrases.where("phrase <> '' and becomes is not null").orderBy("phrase", "becomes"), "phrase", "becomes")

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        root = trie(sent.value)
        return texts.map(lambda t: t if t is None else replaced(t, root))

    return lambda text: convert(text)


# ---- words ----------------------------------------------------------------------------------------------------------


class Words:
    """The most probable cut of a text into dictionary words; characters that no word covers stand alone, as if seen once."""

    def __init__(self, entries: list[tuple[str, int, str]]):
        self.known: dict[str, tuple[int, str]] = {}
        for word, freq, tag in sorted(entries, key=lambda e: (e[0], -(e[1] or 0), e[2] or "")):
            if word:
                self.known.setdefault(word, (max(freq or 1, 1), tag or ""))
        self.total = math.log(sum(f for f, _ in self.known.values()) or 1)
        self.longest = max(map(len, self.known), default=1)

    def cut(self, run: str) -> list[str]:
        best = [(0.0, len(run))] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            ends = [j for j in range(i + 1, min(i + self.longest, len(run)) + 1) if j == i + 1 or run[i:j] in self.known]
            best[i] = max((math.log(self.known.get(run[i:j], (1,))[0]) - self.total + best[j][0], j) for j in ends)
        out, i = [], 0
        while i < len(run):
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    def tag(self, word: str) -> str:
        return self.known.get(word, (0, ""))[1]

    def freq(self, word: str) -> int:
        return self.known.get(word, (0, ""))[0]

    def names(self, text: str) -> list[tuple[str, str]]:
        """(term, kind) in order, each term once: see proper_nouns()."""
        found: dict[str, str] = {}
        for run in _RUN.findall(text):
            words = self.cut(run)
            for i, w in enumerate(words):
                kind = self.tag(w)
                if kind == "nr" and 2 <= len(w) <= PERSON:
                    found.setdefault(w, "person")
                elif kind == "ns":
                    found.setdefault(w, "place")
                elif kind == "nt" and len(w) >= ORGANISATION and self.freq(w) < COMMON:
                    found.setdefault(w, "organisation")
                elif kind == "surname":
                    given = ""
                    for x in words[i + 1 : i + 3]:
                        if len(x) > 1 or x in self.known:
                            break
                        given += x
                    if given:
                        found.setdefault(w + given, "person")
                elif kind == "kin" and i:
                    head = words[i - 1]
                    if len(head) <= 3 and self.tag(head) != "function" and head not in found and (len(head) == 1 or self.freq(head) < RARE):
                        found.setdefault(head + w, "person")
        for title in _TITLE.findall(text):
            found.setdefault(title, "name")
        return list(found.items())


def segmented(dictionary: DataFrame) -> Callable[[Column], Column]:
    """A function of a text to its words by the dictionary (see DICTIONARY); what isn't Chinese is one piece between them."""
    sent = _sent(dictionary, "word", "freq", "tag")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        words = Words(sent.value)
        pieces = lambda t: [p for part in re.split(f"([{CJK}]+)", t) if part for p in (words.cut(part) if _RUN.fullmatch(part) else [part])]
        return texts.map(lambda t: t if t is None else pieces(t))

    return lambda text: cut(text)


def proper_nouns(dictionary: DataFrame) -> Callable[[Column], Column]:
    """A function of a text to its names, as array<struct<term, kind>>, by tags of the dictionary's words.

    nr, ns and nt are persons, places and organisations. A surname and up to two characters after it that the dictionary
    lacks are a person; so is a kin word with a rare word or one character before it, unless that is tagged function. Titles
    in 《》 are names.
    """
    sent = _sent(dictionary, "word", "freq", "tag")

    @F.pandas_udf("array<struct<term:string,kind:string>>")
    def find(texts: pd.Series) -> pd.Series:
        words = Words(sent.value)
        return texts.map(lambda t: t if t is None else [{"term": a, "kind": b} for a, b in words.names(t)])

    return lambda text: find(text)


# ---- sounds ---------------------------------------------------------------------------------------------------------


def _sounds(names: DataFrame, name: str, readings: DataFrame) -> DataFrame:
    """(name, _sounds): the readings of each character of each different name, in order; one without a reading is its own."""
    chars = names.select(name).distinct().select(name, F.posexplode(F.split(key_of(F.col(name)), "")).alias("_pos", "char")).where("char <> ''")
    known = readings.where("char is not null and reading is not null").groupBy("char").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("ord", F.lit(0)).alias("ord"), "reading"))).alias("_r"))
    j = chars.join(known, "char", "left").withColumn("_r", F.coalesce(F.array_distinct(F.transform("_r", lambda x: x["reading"])), F.array("char")))
    return j.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_r"))), lambda x: x["_r"]).alias("_sounds"))


def every_sound(names: DataFrame, name: str, readings: DataFrame) -> DataFrame:
    """Rows of names with sound, once for each way that the name may sound by the readings (char, reading, ord).

    The ways are the product of the readings of its characters, of which names have few.
    """
    ways = F.aggregate("_sounds", F.array(F.lit("")), lambda done, here: F.flatten(F.transform(done, lambda a: F.transform(here, lambda x: F.concat_ws(" ", F.nullif(a, F.lit("")), x)))))
    return names.join(_sounds(names, name, readings).select(name, F.explode(F.array_distinct(ways)).alias("sound")), name)


def usual_sound(names: DataFrame, name: str, readings: DataFrame) -> DataFrame:
    """Rows of names with sound, by the reading of each character that has the least ord."""
    usual = F.array_join(F.transform("_sounds", lambda x: F.get(x, 0)), " ")
    return names.join(_sounds(names, name, readings).select(name, usual.alias("sound")), name, "left")
