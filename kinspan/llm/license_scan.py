"""License scan by diagonal voting over word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm.common import WordHashes, prefix_sums, row_key, staged, window_hashes

#: Phrases and labels that are given.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Opening or notice texts of common licenses, by label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved"),
)
GRAM = 3
#: Diagonals this far apart belong to one span: words put in or left out.
NEAR = 3
#: Share of a template's k-grams that a span must hold; of a template with fewer than LONG k-grams it must hold all.
SHARE, LONG = 0.65, 12

#: Bytes to bytes: A-Z to a-z, other bytes of the class [\x00-\x2F\x3A-\x60\x7B-\x7F] to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def _phrases(docs: DataFrame) -> DataFrame:
    """Base places of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = [(f" {p} ".encode(), label) for p, label in PHRASES]
        for x in batches:
            rows = []
            for text in x["text"]:
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                hits, labels = [], set()
                for phrase, label in wanted:
                    at = joined.find(phrase)
                    while at >= 0:
                        hits.append(at)
                        labels.add(label)
                        at = joined.find(phrase, at + 1)
                # the word at a place is the number of spaces before it
                starts = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), hits).tolist() if hits else []
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)))
            out = x.drop(columns="text")
            out["n_words"], out["n_base"] = [r[0] for r in rows], [r[1] for r in rows]
            out["first_word"], out["last_word"] = pd.array([r[2] for r in rows], "Int64"), pd.array([r[3] for r in rows], "Int64")
            out["base"] = [r[4] for r in rows]
            yield out

    return docs.select("doc_id", "_key", "_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _key long, _id long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """The hash of each text's word k-grams, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            each = [window_hashes(prefix_sums(hashes.of(words_of(t.as_py()))), k) for t in b.column(2)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            flat = pa.array(np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), flat)], ["_key", "_id", "grams"])

    return docs.select("_key", "_id", "text").mapInArrow(run, "_key long, _id long, grams array<long>")


def template_positions(spark: SparkSession, k: int = GRAM) -> DataFrame:
    """(gram, template, label, at, of): a table of fixed size."""
    rows, hashes = [], WordHashes()
    for i, (label, text) in enumerate(TEMPLATES):
        h = window_hashes(prefix_sums(hashes.of(words_of(text))), k).view(np.int64)
        rows += [(int(g), i, label, at, len(h)) for at, g in enumerate(h)]
    return spark.createDataFrame(rows, "gram long, template int, label string, at int, of int")


def pieces(diagonals: np.ndarray, at: np.ndarray, of: int) -> list[tuple[int, int, int]]:
    """(start, end, held) of spans under twice the template's length: the whole chain if it is, else disjoint parts of it.

    Of each hit and those that follow within reach, a part ends where it holds all template positions there; parts that
    hold most come first.
    """
    places = diagonals + at
    order = np.lexsort((at, places))
    places, at = places[order], at[order]
    if places[-1] - places[0] < 2 * of:
        return [(int(places[0]), int(places[-1]), len(set(at.tolist())))]
    after = np.searchsorted(places, places + 2 * of)
    held, last = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for i in range(len(places)):
        seen, last[i] = set(), i
        for j in range(i, after[i]):
            if at[j] not in seen:
                seen.add(at[j])
                last[i] = j
        held[i] = len(seen)
    out, taken = [], np.zeros(len(places), bool)
    for i in np.lexsort((last - np.arange(len(places)), -held)):
        if not taken[i : last[i] + 1].any():
            taken[i : last[i] + 1] = True
            out.append((int(places[i]), int(places[last[i]]), int(held[i])))
    return sorted(out)


def _pieces(chains: DataFrame) -> DataFrame:
    """The rows of chains with their spans in place of their hits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [pieces(np.array([h["diagonal"] for h in hits]), np.array([h["at"] for h in hits]), of) for hits, of in zip(x["hits"], x["of"], strict=True)]
            out = x.drop(columns="hits").loc[x.index.repeat([len(f) for f in found])]
            out["start"], out["end"], out["held"] = [np.array([p[i] for f in found for p in f], np.int64) for i in range(3)]
            yield out

    return chains.mapInPandas(run, "_key long, _id long, template int, label string, of int, start int, end int, held int")


def spans(docs: DataFrame, k: int = GRAM) -> DataFrame:
    """(_key, _id, template, label, start, end, score): verified spans of templates, as k-gram positions.

    Every rolling k-gram is joined with the template positions; hits vote for the diagonal position - template position;
    diagonals no more than NEAR apart are merged into a chain; one that is not shorter than twice the template, as where
    a short template or a part of one is repeated, is cut into spans that are; a span is kept if it holds SHARE of the
    template's k-grams or more (a short template: all).
    """
    hits = _grams(docs, k).select("_key", "_id", F.posexplode("grams").alias("place", "gram"))
    hits = hits.join(F.broadcast(template_positions(docs.sparkSession, k)), "gram")
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    key = ["_key", "_id", "template", "label", "of"]
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("at"))
    by_diagonal = Window.partitionBy(*key).orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEAR, F.lit(True)).cast("int")
    votes = votes.withColumn("new", new).withColumn("span", F.sum("new").over(by_diagonal))
    hit = F.transform("at", lambda x: F.struct(F.col("diagonal").alias("diagonal"), x.alias("at")))
    chains = votes.withColumn("hit", hit).groupBy(*key, "span").agg(F.flatten(F.collect_list("hit")).alias("hits"))
    found = _pieces(chains.select(*key, "hits")).withColumn("score", F.col("held") / F.col("of"))
    return found.where(F.col("score") >= F.when(F.col("of") < LONG, 1.0).otherwise(SHARE)).select("_key", "_id", "template", "label", "start", "end", "score")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row.

    Base labels are given phrases found as consecutive words, the other labels verified template spans; score is 1 with a
    base label, else the best share of a template held, else 0. Null and empty texts have no words and no labels (empty
    strings); texts of any length are read whole; spans of equal score all give their labels; repeated rows repeat; extra
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    keyed = row_key(docs)
    found = spans(keyed).groupBy("_key", "_id").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    d = _phrases(keyed).join(staged(found, "license-spans"), ["_key", "_id"], "left")
    labels = F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))
