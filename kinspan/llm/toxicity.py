"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm.common import drop, held_out, in_share, staged

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that can vote as patterns.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Patterns of the way of writing that vote too: shouted words, runs of marks, masked words, direct address.
PATTERNS = {
    "#shout": re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}"),
    "#marks": re.compile(r"[!?]{3}"),
    "#masked": re.compile(r"\b[A-Za-z]+[*@$#]{2,}[A-Za-z]*\b"),
    "#address": re.compile(r"(?i)\byou(?:'re| are)? (?:all |such )?(?:a|an)\b"),
}


def features(text: str | None) -> set[str]:
    """The words of a text, their beginnings (marked by a star) and the patterns found (by name)."""
    words = set(LETTERS.findall(text.lower())) if text else set()
    out = set(words)
    for n in BEGINNINGS:
        out.update(f"{w[:n]}*" for w in words if len(w) > n)
    if text:
        out.update(name for name, p in PATTERNS.items() if p.search(text))
    return out


def learning_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most about `most` labelled rows that are not held out, chosen by a hash of the id.

    A document labelled more than once is toxic if one of its labels says so. The choice is made on either table before
    the join, so only the texts of chosen documents are moved.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.count()
    name = F.col("doc_id").cast("string")
    lot = in_share(name, min(1.0, most / max(n, 1)))
    known = known.where(lot).groupBy(name.alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(name.alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & lot)
    return texts.join(known, "doc_id")


def frequencies(rows: DataFrame, least: int, most: int = 40_000) -> list[tuple[str, int, int]]:
    """(feature, pos, n): in how many toxic documents and in how many documents the features occur that at least `least`
    toxic documents have; no more than `most` of them, the most frequent ones."""

    def count(known):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            among = known.value if known is not None else None
            for x in batches:
                n: dict[str, int] = {}
                for text in x["text"]:
                    found = features(text)
                    for f in found if among is None else found & among:
                        n[f] = n.get(f, 0) + 1
                yield pd.DataFrame(list(n.items()), columns=["feature", "n"])

        return run

    schema = "feature string, n long"
    toxic = rows.where("toxic = 1").select("text").mapInPandas(count(None), schema).groupBy("feature").agg(F.sum("n").alias("n"))
    top = {r["feature"]: r["n"] for r in toxic.where(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(most).collect()}
    known = rows.sparkSession.sparkContext.broadcast(frozenset(top))
    clean = rows.where("toxic = 0").select("text").mapInPandas(count(known), schema).groupBy("feature").agg(F.sum("n").alias("n"))
    other = {r["feature"]: r["n"] for r in clean.collect()}
    return [(f, n, n + other.get(f, 0)) for f, n in top.items()]


def choose_voters(counts: list[tuple[str, int, int]], n: int, positive: int, most: int, least: float = 2.0, few: int = 10) -> list[str]:
    """Features surely more frequent in toxic documents than elsewhere; of nested ones the surest, then the longest.

    counts: (feature, toxic documents with it, all documents with it), of n documents of which `positive` are toxic. A
    feature is ranked by the log of how many times more frequent it is, less two standard errors of that, so one seen in a
    few texts, as the rare words of copies are, does not vote; `least` is the least such value. Where no more than `few`
    reach it, as with few labels, so many of those above 0.35 of it vote.
    """
    ranked = []
    for f, pos, all_ in counts:
        lift = math.log((pos + 0.5) / (positive + 1)) - math.log((all_ - pos + 0.5) / (n - positive + 1))
        sure = lift - 2 * math.sqrt(1 / (pos + 0.5) + 1 / (all_ - pos + 0.5))
        if sure > 0.35 * least:
            ranked.append((sure, f))
    ranked.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    chosen: list[str] = []
    for sure, f in ranked:
        if sure <= least and len(chosen) >= few:
            break
        stem = f.rstrip("*")
        # of nested features the stronger one votes
        if any(stem.startswith(c[:-1]) for c in chosen if c.endswith("*")) or (f.endswith("*") and any(c.rstrip("*").startswith(stem) for c in chosen)):
            continue
        chosen.append(f)
        if len(chosen) == most:
            break
    return chosen


def correlations(votes: np.ndarray, least: float = 0.3) -> np.ndarray:
    """How far two voters move together among the texts in which some third one fires, 0 where under `least`.

    Independent voters of a class don't, whatever their class is; near-copies of a voter, and words of one kind of text, do.
    """
    m = votes.shape[1]
    out, total = np.eye(m), votes.sum(axis=1)
    for i in range(m):
        for j in range(i):
            here = total - votes[:, i] - votes[:, j] > 0
            n = int(here.sum())
            if not n:
                continue
            a, b = votes[here, i], votes[here, j]
            pa, pb, both = a.mean(), b.mean(), (a @ b) / n
            spread = math.sqrt(pa * (1 - pa) * pb * (1 - pb))
            if spread and (both - pa * pb) / spread >= least:
                out[i, j] = out[j, i] = min((both - pa * pb) / spread, 1.0)
            elif pa * pb == 1:
                out[i, j] = out[j, i] = 1.0
    return out


class LabelModel:
    """Two classes, voters that fire or abstain: how often each fires in either class, learnt with the class by EM.

    Only the votes are looked at: what tells the classes apart is which voters fire in the same texts. EM starts from the
    texts in which two voters or groups of them agree. A voter that abstains says nothing, since toxic texts of different kinds have different
    words; only that none fires at all is evidence too. In each text the evidence of a voter is divided by the number of voters
    firing there that it is correlated with, so a group of near-copies counts about once.
    """

    def __init__(self, votes: np.ndarray, rounds: int = 10):
        some = votes.any(axis=1)
        self.together = correlations(votes)
        agree = (votes / np.maximum(votes @ self.together, 1.0)).sum(axis=1)
        post = np.select([agree >= 1.5, some], [0.98, 0.4], 0.02)
        for _ in range(rounds):
            self.prior = min(max(float(post.mean()) if len(post) else 0.5, 1e-3), 0.5)
            one, two = post.sum(), (1 - post).sum()
            self.fires = np.stack([((1 - post) @ votes + 0.02) / (two + 1.0), (post @ votes + 0.02) / (one + 1.0)])
            none = np.array([((1 - post) @ ~some + 0.5) / (two + 1), (post @ ~some + 0.5) / (one + 1)])
            self.silent = float(np.log(none[1] / none[0]))
            post = self.posterior(votes)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = votes * np.log(self.fires[1] / self.fires[0]) / np.maximum(votes @ self.together, 1.0)
        z = math.log(self.prior / (1 - self.prior)) + np.where(votes.any(axis=1), on.sum(axis=1), self.silent)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def oriented(post: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Posteriors of the class that the given labels call toxic: of the two, the one more frequent among those labelled so."""
    if given.any() and not given.all() and post[given > 0].mean() < post[given == 0].mean():
        return 1 - post
    return post


def train_linear(hits: list[list[int]], columns: int, y: np.ndarray, decay: float = 3e-4, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression on soft labels by accelerated gradient descent; weights are kept from falling below 0.

    hits: for each row the columns that are 1 in it.
    """
    w, bias = np.zeros(columns), -2.0
    momentum, mb = np.zeros_like(w), 0.0
    n = max(len(hits), 1)
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.array([c for h in hits for c in h], np.int64)
    # classes weigh alike
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 0.999)
    each = (y / share + (1 - y) / (1 - share)) / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(hits)), -30, 30)))
        g = (p - y) * each
        momentum = 0.9 * momentum + np.bincount(col, g[row], columns) / n + decay * w
        mb = 0.9 * mb + g.mean() if len(g) else 0.0
        w, bias = np.maximum(w - 1.0 * momentum, 0.0), bias - 0.5 * mb
    return bias, w


class Model:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def scorer(self, limit: int = 400_000):
        weights, bias, lengths = self.weights, self.bias, BEGINNINGS
        patterns = [(name, p) for name, p in PATTERNS.items() if name in weights]
        met: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            if len(met) > limit:
                met.clear()
            hits: set[str] = set()
            for w in LETTERS.findall(text.lower()) if text else ():
                f = met.get(w)
                if f is None:
                    f = met[w] = tuple(x for x in (w, *[f"{w[:n]}*" for n in lengths if len(w) > n]) if x in weights)
                if f:
                    hits.update(f)
            hits.update(name for name, p in patterns if text and p.search(text))
            z = bias + sum(weights[f] for f in sorted(hits))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000, most_voters: int = 80, most_features: int = 1500) -> Model:
    """Learns from at most about most_rows labelled rows that are not held out.

    The lexicon is drawn from these rows: words, word beginnings and patterns of writing surely more frequent in those
    labelled toxic become voters. The label model learns from the votes alone how far each can be trusted and which move together;
    the labels only say which of its classes is the toxic one. The classifier is trained on the posterior labels over
    most_features words and beginnings, so it also knows words that no voter has. Without rows labelled toxic, or a
    feature that votes, all texts get the same low score.
    """
    rows = staged(learning_rows(docs, labels, most_rows), "toxic-learning")
    n, positive = rows.agg(F.count("*"), F.sum("toxic")).first()
    positive = int(positive or 0)
    if not n or not positive:
        return Model(-3.0, {})
    counts = frequencies(rows, min(3, positive))
    voters = choose_voters(counts, n, positive, most_voters)
    if not voters:
        return Model(-3.0, {})
    by_lift = sorted(counts, key=lambda c: (-(math.log((c[1] + 0.5) / (positive + 1)) - math.log((c[2] - c[1] + 0.5) / (n - positive + 1))) * math.sqrt(c[1]), c[0]))
    names = list(dict.fromkeys([*voters, *[c[0] for c in by_lift[:most_features]]]))
    place = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"toxic": x["toxic"], "hits": [sorted(place[f] for f in features(t) if f in place) for t in x["text"]]})

    found = rows.select("text", "toxic").mapInPandas(run, "toxic int, hits array<int>").collect()
    drop(rows)
    hits = [r["hits"] for r in found]
    votes = np.zeros((len(hits), len(voters)))
    for i, h in enumerate(hits):
        votes[i, [c for c in h if c < len(voters)]] = 1
    post = oriented(LabelModel(votes).posterior(votes), np.array([r["toxic"] for r in found], float))
    bias, w = train_linear(hits, len(names), post)
    return Model(float(bias), {f: float(v) for f, v in zip(names, w, strict=True) if v > 1e-3})


def score(docs: DataFrame, model: Model, keep=()) -> DataFrame:
    """Adds score to doc_id and the columns in keep, from the whole text only.

    Null and empty texts have no feature and get the score of the bias alone; equal texts have equal scores; texts of any
    length are read whole. Rows stay one to one, repeated ones and null ids too; an empty table gives an empty result.
    Other columns are ignored; those in keep must not be called score.
    """
    box = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    columns = list(dict.fromkeys(["doc_id", *[c for c in keep if c != "text"]]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Model(*box.value).scorer()
        for x in batches:
            out = x[columns].copy()
            out["score"] = [of(t) for t in x["text"]]
            yield out

    return docs.select(*columns, "text").mapInPandas(run, schema)
