"""Language identification: word-first backoff to ever shorter character n-grams."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.llm.common import held_out, staged

#: Word characters of Python that are neither letters nor decimal digits: fractions, superscripts, Roman and circled numbers.
NUMBERS = re.escape("".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()) + "".join(c for c in map(chr, range(0x3000)) if c.isdigit() and not c.isdecimal() and not c.isnumeric()))
LETTERS = re.compile(rf"[^\W\d_{NUMBERS}]+")
#: Runs of word characters without decimal digits: few have anything but letters in them.
RUNS = re.compile(r"[^\W\d_]+")
LONGEST = 5
COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("feature", pa.string()), ("times", pa.int64())])


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    found = RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ((x,) if x.isalpha() else LETTERS.findall(x))]


class Model:
    """Log frequencies of words and of character n-grams (1 to LONGEST, word ends marked) per language.

    A table of features holds, for each, the languages that have it; all others share one value per language and size, so
    its length follows from the features of each language, not from their product with the languages. Tables are columns
    throughout: the driver makes no object per feature, and only workers look features up.
    """

    def __init__(self, counts: pa.Table | list[tuple[str, int, str, int]], totals: list[tuple[str, int, int]], documents: dict[str, int], known: dict[int, int], smooth: float = 0.5):
        """counts: (language, size, feature, times), size 0 for words; totals: times of all features per language and size; known: features per size."""
        self.langs = sorted(documents)
        column = {lang: i for i, lang in enumerate(self.langs)}
        total = sum(documents.values()) or 1
        self.prior = np.array([math.log(documents[x] / total) for x in self.langs])
        sums = np.zeros((LONGEST + 1, len(self.langs)))
        for lang, size, times in totals:
            sums[size, column[lang]] = times
        space = np.array([[known.get(size, 0)] for size in range(LONGEST + 1)])
        norm = np.log(sums + smooth * space + 1e-9)
        self.base = (math.log(smooth) - norm).astype(np.float32)
        if not isinstance(counts, pa.Table):
            counts = pa.Table.from_pylist([dict(zip(COUNTS.names, x, strict=True)) for x in counts], schema=COUNTS)
        self.tables = []
        for size in range(LONGEST + 1):
            t = counts.filter(pc.equal(counts["size"], size)).combine_chunks()
            feature = pa.array(t["feature"], pa.string()) if not t.num_rows else t["feature"].combine_chunks()
            coded = feature.dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            lang = pc.index_in(t["lang"], value_set=pa.array(self.langs, pa.string())).to_numpy()[order].astype(np.int32)
            value = np.log(t["times"].to_numpy()[order] + smooth) - norm[size, lang]
            start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(coded.dictionary)))])
            self.tables.append((coded.dictionary, start, lang, value.astype(np.float32)))
        self.dense: list[np.ndarray | None] = [None] * (LONGEST + 1)

    def state(self) -> tuple:
        """Plain data for a broadcast, which workers can read without this module."""
        return self.langs, self.prior, self.base, self.tables

    @classmethod
    def of(cls, state: tuple) -> Model:
        model = cls.__new__(cls)
        model.langs, model.prior, model.base, model.tables = state
        model.dense = [model._dense(size) for size in range(LONGEST + 1)]
        return model

    @cached_property
    def index(self) -> list[dict[str, int]]:
        """The number of each word (size 0) or n-gram."""
        return [{f: i for i, f in enumerate(names.to_pylist())} for names, *_ in self.tables]

    def _dense(self, size: int, cells: int = 8_000_000) -> np.ndarray | None:
        """A row of log frequencies per feature, if so many fit; else they are put together when asked for."""
        names, start, lang, value = self.tables[size]
        if len(names) * max(len(self.langs), 1) > cells:
            return None
        out = np.repeat(self.base[size][None, :], len(names), axis=0)
        out[np.repeat(np.arange(len(names)), np.diff(start)), lang] = value
        return out

    def features(self, at: list[int], size: int) -> np.ndarray:
        """Log frequencies of words (size 0) or n-grams, by their numbers, in each language."""
        if self.dense[size] is not None:
            return self.dense[size].take(at, axis=0)
        _, start, lang, value = self.tables[size]
        out = np.repeat(self.base[size][None, :], len(at), axis=0)
        for row, i in zip(out, at, strict=True):
            row[lang[start[i] : start[i + 1]]] = value[start[i] : start[i + 1]]
        return out

    def vector(self, word: str) -> np.ndarray:
        """Evidence of one word: its own log frequencies, else the mean over its longest known n-grams."""
        known = self.index[0].get(word)
        if known is not None:
            return self.features([known], 0)[0]
        marked = f" {word} "
        for size in range(min(LONGEST, len(marked)), 0, -1):
            names = self.index[size]
            hits = [i for at in range(len(marked) - size + 1) if (i := names.get(marked[at : at + size])) is not None]
            if hits:
                return np.add.reduce(self.features(hits, size)) / len(hits)
        return np.zeros(len(self.langs), np.float32)

    def scorer(self, cells: int = 2_000_000):
        """text -> (language or und, score), with a table of words met before that is emptied when full."""
        slots: dict[str, int] = {}
        limit = max(1024, cells // max(len(self.langs), 1))
        rows = np.zeros((1024, len(self.langs)), np.float32)

        def slot(word: str) -> int:
            nonlocal rows
            at = slots.get(word)
            if at is None:
                at = len(slots)
                if at == len(rows):
                    rows = np.concatenate([rows, np.zeros_like(rows)])
                rows[at] = self.vector(word)
                slots[word] = at
            return at

        def score(text: str | None) -> tuple[str, float]:
            found = words_of(text) if text else []
            if not found or not self.langs:
                return "und", 0.0
            sums = self.prior.copy()
            for i in range(0, len(found), 10_000):
                if len(slots) > limit:
                    slots.clear()
                at = [slot(w) for w in found[i : i + 10_000]]  # may replace rows
                sums += rows[at].sum(axis=0, dtype=np.float64)
            p = np.exp(sums - sums.max())
            best = int(np.argmax(p))
            return self.langs[best], float(p[best] / p.sum())

        return score


def fit(docs: DataFrame, per_lang: int = 1500, words_per_lang: int = 40_000, grams_per_lang: int = 40_000) -> Model:
    """Fits on at most about per_lang documents of each language, chosen by a hash of the id among rows not held out.

    Words and n-grams of these are counted whole. The model then holds the words_per_lang most frequent words and the
    grams_per_lang most frequent n-grams of each language by itself, so no language takes another's place; the driver and
    the broadcast get so many features per language at most. Every language is learnt.
    """
    d = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    documents = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not documents:
        return Model([], [], {}, {})
    share = F.create_map(*[x for lang, n in sorted(documents.items()) for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))])
    lot = F.pmod(F.xxhash64(F.lit("share"), "doc_id"), F.lit(1_000_000)) / 1e6
    d = d.where(lot < share[F.col("lang")])
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    counts = staged(d.select("lang", words.alias("feature")).groupBy("lang", "feature").agg(F.count("*").alias("times")), "lang-words")
    marked = F.concat(F.lit(" "), F.col("feature"), F.lit(" "))
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(LONGEST)),
            lambda n: F.transform(
                F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>")),
                lambda at: F.struct(n.alias("size"), F.substring(marked, at, n).alias("feature")),
            ),
        )
    )
    grams = counts.select("lang", "times", F.explode(pieces).alias("x")).groupBy("lang", "x.size", "x.feature").agg(F.sum("times").alias("times"))
    every = staged(counts.select("lang", F.lit(0).alias("size"), "feature", "times").union(grams.select("lang", "size", "feature", "times")), "lang-features")
    totals = [tuple(r) for r in every.groupBy("lang", "size").agg(F.sum("times")).collect()]
    known = {r["size"]: r["n"] for r in every.groupBy("size").agg(F.countDistinct("feature").alias("n")).collect()}
    is_word = (F.col("size") == 0).cast("int")
    rank = F.row_number().over(Window.partitionBy("lang", is_word).orderBy(F.desc("times"), "size", "feature"))
    top = every.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("size") == 0, words_per_lang).otherwise(grams_per_lang))
    return Model(top.select(*COUNTS.names).toArrow(), totals, documents, known)


def predict(docs: DataFrame, model: Model, keep=()) -> DataFrame:
    """Adds lang_pred and score to doc_id and the columns in keep, from the whole text only.

    Null texts and texts without a letter give und and 0; words unknown down to single letters carry no evidence, and a
    text of such words alone gets the most frequent language. A letter is one to Unicode; digits, fractions, superscripts
    and number signs aren't. Of languages that tie the first by code point is given. Without any labelled row all rows give
    und. Texts of any length are read whole, in pieces of words. Rows stay one to one: repeated rows and null ids are kept;
    an empty table gives an empty result. Other columns are ignored; those in keep must not be called lang_pred or score.
    """
    box = docs.sparkSession.sparkContext.broadcast(model.state())
    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    kept = [c for c in columns if c != "text" or "text" in keep]
    d = docs.select(*columns)
    schema = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in kept) + ", lang_pred string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Model.of(box.value).scorer()
        for x in batches:
            found = [score(t) for t in x["text"]]
            out = x[kept].copy()
            out["lang_pred"] = [a for a, _ in found]
            out["score"] = [b for _, b in found]
            yield out

    return d.mapInPandas(run, schema)
