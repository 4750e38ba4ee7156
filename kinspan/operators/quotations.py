"""Finding quoted passages in transcripts, word for word or nearly so, by indexes of a case's words that passages stream past.

A case's words are cut into chunks of a bounded number of characters. Each chunk becomes an index in one task, and the case's
passages are read past it a batch at a time, so neither a row for each run of a passage nor one for each run of a line is
ever shuffled. Word for word: the lines, joined without spaces, are cut so that chunks overlap and a passage over several
lines is within one; the index has the hashes of all stretches of HEAD characters. Nearly: if a passage fits a stretch of a
line with a ratio of FIDELITY, a bounded number of its characters is unmatched, and each spoils a bounded number of runs of Q
characters. The index has the lines of each run, and lines that share too few runs with the passage are left out. Nothing
that reaches FIDELITY is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from kinspan.functions import fuzzy
from kinspan.sources.stage import kept

#: Characters of a run; of a block, without what it shares with the next; longest passage looked for.
Q, BLOCK, LONGEST = 3, 1024, 400
#: Characters of a case that one index holds; characters of a passage that are looked up by hash; cells of a count of shared runs.
CHUNK, HEAD, CELLS = 1 << 20, 16, 1 << 21
_WEIGHTS = np.cumprod(np.full(HEAD, 0x9E3779B97F4A7C15, np.uint64))


def runs(text: str) -> Column:
    """All runs of Q characters, with repeats; none of a shorter text."""
    n = F.length(text) - Q + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(Q)))).otherwise(F.array().cast("array<string>"))


def blocks(lines: DataFrame, width: int = BLOCK) -> DataFrame:
    """(case_id, block, text): the lines (case_id, session_id, seq, line) in order, LONGEST characters of each block also in the one before."""
    size = F.length("line")
    sessions = lines.groupBy("case_id", "session_id").agg(F.sum(size).alias("_n"))
    sessions = sessions.withColumn("_from", F.coalesce(F.sum("_n").over(Window.partitionBy("case_id").orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.coalesce(F.sum(size).over(Window.partitionBy("case_id", "session_id").orderBy("seq", "line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.where("line <> ''").withColumn("_at", at).join(sessions, ["case_id", "session_id"]).withColumn("_at", F.col("_at") + F.col("_from"))
    first = F.greatest(F.floor((F.col("_at") - width - LONGEST) / width) + 1, F.lit(0))
    pieces = placed.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("_at") + size - 1) / width))))
    start = F.greatest(F.col("block") * width - F.col("_at"), F.lit(0))
    end = F.least((F.col("block") + 1) * width + LONGEST - F.col("_at"), size.cast("long"))
    piece = F.struct("_at", F.substring(F.col("line"), (start + 1).cast("int"), (end - start).cast("int")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["s"]), "")
    return pieces.groupBy("case_id", "block").agg(joined.alias("text"))


def _ranked(passages: DataFrame, seen: DataFrame) -> DataFrame:
    """(case_id, needle, run, times, before): runs of passages from the rarest on; before: how many come first, with repeats.

    seen: the runs of all that is searched; a run that isn't there is the rarest.
    """
    n = seen.groupBy("run").agg(F.count("*").alias("_df"))
    own = passages.select("case_id", "needle", F.explode(runs("needle")).alias("run")).groupBy("case_id", "needle", "run").agg(F.count("*").alias("times"))
    own = own.join(n, "run", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    w = Window.partitionBy("case_id", "needle").orderBy("_df", "run").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("before", F.coalesce(F.sum("times").over(w), F.lit(0))).drop("_df")


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _past(held: DataFrame, passages: DataFrame, index: Callable[[list[str]], Callable[[list[str]], dict]], *more: StructField) -> DataFrame:
    """(case_id, needle, more): what index(texts of a chunk)(needles) tells of some of the needles, for every chunk of their case.

    held: (case_id, chunk, text); index gets the texts of a chunk in their order. The columns that it gives begin with the needle.
    """
    chunks = held.select("case_id", "chunk").distinct()
    asked = passages.join(chunks, "case_id").select("case_id", "chunk", F.lit(1).alias("kind"), F.col("needle").alias("text"))
    held = held.join(passages.select("case_id").distinct(), "case_id", "left_semi")
    rows = held.select("case_id", "chunk", F.lit(0).alias("kind"), "text").unionByName(asked)
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "case_id", "chunk").sortWithinPartitions("case_id", "chunk", "kind", "text")
    names = ["needle", *[f.name for f in more]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, texts, look = None, [], None
        for b in batches:
            keys, said, i = list(zip(b["case_id"], b["chunk"], b["kind"], strict=True)), list(b["text"]), 0
            out = {c: [] for c in ("case_id", *names)}
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i][:2] != at:
                    at, texts, look = keys[i][:2], [], None
                if keys[i][2] == 0:
                    texts += said[i:j]
                else:
                    look = look or index(texts)
                    found = look(said[i:j])
                    out["case_id"] += [at[0]] * len(found["needle"])
                    for c in names:
                        out[c] += found[c]
                i = j
            yield pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in out.items()})

    return rows.mapInPandas(work, StructType([passages.schema["case_id"], StructField("needle", StringType()), *more]))


def _holds(texts: list[str]) -> Callable[[list[str]], dict]:
    """The needles that are in a text."""
    text = "".join(texts)

    def heads(points: np.ndarray) -> np.ndarray:
        """Hashes of the HEAD characters from each place on that has so many."""
        n = max(len(points) - HEAD + 1, 0)
        return sum((points[k : k + n].astype(np.uint64) * w for k, w in enumerate(_WEIGHTS)), np.zeros(n, np.uint64))

    there = np.unique(heads(_points([text])))

    def look(needles: list[str]) -> dict:
        long = [x for x in needles if len(x) >= HEAD]
        hashes = heads(_points([x[:HEAD] for x in long]))[::HEAD]
        maybe = [x for x, known in zip(long, np.isin(hashes, there), strict=True) if known] + [x for x in needles if len(x) < HEAD]
        return {"needle": [x for x in maybe if x in text]}

    return look


def _alike(least: float) -> Callable[[list[str]], Callable[[list[str]], dict]]:
    """The lines of which a stretch shares runs enough with a needle, and the first line that shares most, with how many it shares."""

    def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The runs of all texts as numbers, and whose each is."""
        p, n = _points(texts).astype(np.int64), np.array([len(x) for x in texts], np.int64)
        if len(p) < Q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(texts)), n)
        m = len(p) - Q + 1
        run = sum(p[k : k + m] << (21 * (Q - 1 - k)) for k in range(Q))
        whole = of[:m] == of[Q - 1 :]
        return run[whole], of[:m][whole]

    def index(texts: list[str]) -> Callable[[list[str]], dict]:
        run, of = cut(texts)
        known, number = np.unique(run, return_inverse=True)
        pairs = np.unique(number * len(texts) + of)  # each line once for each of its runs, by run
        lines_of, first = pairs % len(texts), np.searchsorted(pairs, np.arange(len(known) + 1) * len(texts))
        sizes = np.array([len(x) for x in texts], np.int64)
        begins = np.searchsorted(of, np.arange(len(texts) + 1))

        def close(own: np.ndarray, n: int, line: int, least: float) -> bool:
            """Whether a stretch of n characters of the line has so many of a needle's runs, own by number."""
            upto = np.cumsum(own[number[begins[line] : begins[line + 1]]])
            wide = n - Q + 1
            return bool(max(upto[wide - 1], (upto[wide:] - upto[:-wide]).max(initial=0)) >= least)

        def some(needles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            run, whose = cut(needles)
            met = np.minimum(np.searchsorted(known, run), len(known) - 1)
            here = known[met] == run
            met, whose = met[here], whose[here]
            many = first[met + 1] - first[met]
            each = np.repeat(first[met] - np.cumsum(many) + many, many) + np.arange(many.sum())
            hits = np.bincount(np.repeat(whose, many) * len(texts) + lines_of[each], minlength=len(needles) * len(texts)).reshape(len(needles), -1)
            n = np.array([len(x) for x in needles], np.int64)[:, None]
            # a stretch as long as the needle leaves as many characters unmatched as the needle; a run goes by one of its
            # own or by one that comes between
            spoils = np.where(sizes > n, (2 * Q - 1) * np.floor((1 - least) * n + 1e-9), Q * np.floor(2 * (1 - least) * n + 1e-9))
            fits, best = (hits >= n - Q + 1 - spoils) & (hits > 0), hits.argmax(axis=1)
            own = np.zeros(len(known), bool)
            for i in np.flatnonzero((fits & (sizes > n)).any(axis=1)):
                mine = met[slice(*np.searchsorted(whose, [i, i + 1]))]
                own[mine] = True
                for j in np.flatnonzero(fits[i] & (sizes > n[i])):
                    fits[i, j] = close(own, n[i, 0], j, n[i, 0] - Q + 1 - spoils[i, j])
                own[mine] = False
            most = np.zeros_like(fits)
            most[np.arange(len(needles)), best] = hits[np.arange(len(needles)), best] > 0
            i, j = np.nonzero(fits | most)
            return i, j, hits[i, j], fits[i, j]

        def look(needles: list[str]) -> dict:
            step, out = max(CELLS // len(texts), 1), {"needle": [], "line": [], "hits": [], "fits": []}
            for at in range(0, len(needles) if len(known) else 0, step):
                part = needles[at : at + step]
                i, j, hits, fits = some(part)
                out["needle"] += [part[k] for k in i]
                out["line"] += [texts[k] for k in j]
                out["hits"] += hits.tolist()
                out["fits"] += fits.tolist()
            return out

        return look

    return index


def verbatim(passages: DataFrame, lines: DataFrame) -> DataFrame:
    """Passages (case_id, needle) that the lines hold word for word, over as many lines as it takes."""
    parts = kept(blocks(lines, CHUNK).select("case_id", F.col("block").alias("chunk"), "text"))
    return _past(parts, passages.distinct(), _holds).distinct()


def nearest(passages: DataFrame, lines: DataFrame, least: float = fuzzy.FIDELITY) -> DataFrame:
    """(case_id, needle, ratio): how well the best line fits each passage.

    Exact where a line reaches `least`. Else it is of those that share runs enough, and of the one that shares most runs, of
    several the first as text; passages that share none with any line are left out.
    """
    d = kept(lines.where("line <> ''").select("case_id", F.col("line").alias("text")).distinct())
    dealt = d.groupBy("case_id").agg(F.ceil(F.sum(F.length("text")) / CHUNK).alias("_n"))
    d = d.join(dealt, "case_id").withColumn("chunk", F.pmod(F.hash("text"), F.col("_n"))).drop("_n")
    asked = passages.where(F.length("needle") >= Q).select("case_id", "needle").distinct()
    met = _past(d, asked, _alike(least), StructField("line", StringType()), StructField("hits", LongType()), StructField("fits", BooleanType()))
    top = F.row_number().over(Window.partitionBy("case_id", "needle").orderBy(F.desc("hits"), "line")) == 1
    # matching is work for many tasks, however small the rows are
    pairs = met.withColumn("top", top).where("top or fits").select("case_id", "needle", "line").repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.select("case_id", "needle", fuzzy.partial_ratio("needle", "line").alias("ratio"))
    return pairs.groupBy("case_id", "needle").agg(F.max("ratio").alias("ratio"))
