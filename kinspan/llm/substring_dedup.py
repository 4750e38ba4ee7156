"""Substring dedup by relative Lempel-Ziv parsing against routed reference blocks.

A match of `window` words always shares an anchor: the smallest k-gram hash of the window, which depends on the window's
words alone. Each anchor of a document has a context: the words of all windows that it stands for. So what a document has in
common with any other lies in the reference block of one of its anchors, the different contexts of that anchor, and only
there is it parsed. A context seen twice is one factor, whole. Others are factored greedily, each against the block without
itself: the longest match from a place on, compared word by word; a factor of `window` words or more makes its windows
duplicates, and parsing goes on at the first window over the factor's end, so none across a boundary is missed.

A block has BLOCK contexts at most. Windows of an anchor with more of them, as where one phrase stands in very many
different surroundings, are counted by hash instead, so no anchor makes a large group; contexts and windows are only built
where an anchor occurs at least twice. Hashes of contexts and windows are compared within their anchor alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm.common import WordHashes, drop, mix, prefix_sums, row_key, span_hashes, staged, window_hashes

WINDOW = 35
GRAM = 12
#: Contexts of a reference block.
BLOCK = 128


def anchors(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, number of windows) for each anchor of one document's word hashes."""
    n = len(h) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = prefix_sums(h)
    grams = window_hashes(sums, k)
    width = window - k + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    count = np.diff(np.append(first, n))
    place = at[first]
    context = span_hashes(sums, first, first + count + window - 1)
    return grams[place], mix(context ^ ((place - first) * 64 + count).astype(np.uint64)), first, count


def _occurrences(docs: DataFrame, window: int, k: int) -> DataFrame:
    schema = "_key long, _id long, anchor long, context long, first int, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            parts, keys, ids = [], b.column(0), b.column(1)
            for text in b.column(2):
                words = (text.as_py() or "").encode().split()
                parts.append(anchors(hashes.of(words), window, k) if len(words) >= window else None)
            rows = [i for i, x in enumerate(parts) if x is not None]
            if not rows:
                continue
            parts = [parts[i] for i in rows]
            each = np.repeat(rows, [len(x[0]) for x in parts])
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(each)), ids.take(pa.array(each)), pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))],
                ["_key", "_id", "anchor", "context", "first", "n"],
            )

    return docs.select("_key", "_id", "text").mapInArrow(run, schema)


def _segments(docs: DataFrame, window: int, k: int) -> DataFrame:
    """The contexts in column todo: word hashes and the anchor's place for a reference block, or their windows to be counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for x in batches:
            out = []
            for text, todo in zip(x["text"], x["todo"], strict=True):
                h = hashes.of(text.encode().split())
                sums = prefix_sums(h)
                for t in todo:
                    first, end = t["first"], t["first"] + t["n"] + window - 1
                    words = windows = None
                    at = 0
                    if t["c"] > BLOCK:
                        starts = np.arange(first, first + t["n"])
                        windows = span_hashes(sums, starts, starts + window).view(np.int64)
                    else:
                        places = np.arange(first, end - k + 1)
                        at = int(np.argmax(span_hashes(sums, places, places + k).view(np.int64) == t["anchor"]))
                        words = h[first:end].view(np.int64)
                    out.append((t["anchor"], t["context"], t["times"] > 1, t["n"], at, words, windows))
            if out:
                yield pd.DataFrame(out, columns=["anchor", "context", "often", "n", "at", "words", "windows"])

    return docs.mapInPandas(run, "anchor long, context long, often boolean, n int, at int, words array<long>, windows array<long>")


def _extensions(parts: list[np.ndarray], width: int) -> np.ndarray:
    """How many words each two of the parts have in common from their start on."""
    x, size = np.zeros((len(parts), width), np.int64), np.array([len(p) for p in parts])
    for row, p in zip(x, parts, strict=True):
        row[: len(p)] = p
    same = np.minimum.accumulate(x[:, None, :] == x[None, :, :], axis=2).sum(axis=2)
    return np.minimum(same, np.minimum(size[:, None], size[None, :]))


def factors(block: list[tuple[np.ndarray, int, int, bool]], window: int, k: int) -> list[int]:
    """For each context (words, place of the anchor, windows, seen more than once) a bit mask of the windows that factors hold.

    A context seen once is factored against the others; one seen more often is a factor itself.
    """
    left = _extensions([w[:at][::-1] for w, at, _, _ in block], window - k)
    right = _extensions([w[at + k :] for w, at, _, _ in block], window - k)
    gram = np.stack([w[at : at + k] for w, at, _, _ in block])
    fits = (gram[:, None, :] == gram[None, :, :]).all(axis=2)
    np.fill_diagonal(fits, False)
    # longest match to the right of a partner that matches so far to the left, or further
    reach = np.full((len(block), window - k + 1), -1)
    i, j = np.nonzero(fits)
    np.maximum.at(reach, (i, left[i, j]), right[i, j])
    reach = np.maximum.accumulate(reach[:, ::-1], axis=1)[:, ::-1].tolist()
    out = []
    for (_, at, n, often), longest in zip(block, reach, strict=True):
        mask = (1 << n) - 1 if often else 0
        start = n if often else 0
        while start < n:
            more = longest[at - start]
            held = at - start + k + more - window + 1 if more >= 0 else 0
            if held > 0:
                mask |= ((1 << held) - 1) << start
                start += held
            else:
                start += 1
        out.append(mask)
    return out


def _parsed(segments: DataFrame, window: int, k: int) -> DataFrame:
    """(anchor, context, mask) of the contexts of each anchor, parsed against one another. Sorted, so a block is read at once."""
    rows = segments.where("words is not null").select("anchor", "context", "often", "n", "at", "words").repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(x: pd.DataFrame) -> pd.DataFrame:
            anchors_, found = x["anchor"].to_numpy(), []
            rows = list(zip(x["words"], x["at"], x["n"], x["often"], strict=True))
            cuts = [0, *(np.flatnonzero(anchors_[1:] != anchors_[:-1]) + 1).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found += factors(rows[a:b], window, k)
            return pd.DataFrame({"anchor": anchors_, "context": x["context"], "mask": np.array(found, np.int64)})

        for x in batches:
            if len(x):
                x = pd.concat([*held, x]) if held else x
                last = x["anchor"] == x["anchor"].iloc[-1]
                held = [x[last]]
                if not last.all():
                    yield done(x[~last])
        if held:
            yield done(held[0])

    return rows.mapInPandas(run, "anchor long, context long, mask long")


def duplicate_windows(docs: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """(_key, _id, factors): per document the first window and a bit mask of each context with repeated windows."""
    if window - k + 1 > 62 or window <= k:
        raise ValueError("the window must be longer than the anchor, by 61 words at most")
    every = staged(_occurrences(docs, window, k), "rlz-anchors")
    shared = staged(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "rlz-shared")
    occ = staged(every.join(shared, "anchor"), "rlz-candidates")
    drop(every, shared)
    contexts = occ.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct("_key", "_id", "first", "n")).alias("at"))
    contexts = staged(contexts.select("anchor", "context", "times", "at.*"), "rlz-contexts")
    # an anchor with one context has been found whole each time; others make a reference block
    several = staged(contexts.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "rlz-several")
    todo = contexts.join(several, "anchor").groupBy("_key", "_id").agg(F.collect_list(F.struct("anchor", "context", "first", "n", "times", "c")).alias("todo"))
    todo = staged(todo, "rlz-todo")
    text = docs.select("_key", "_id", "text").join(todo, ["_key", "_id"]).dropDuplicates(["_key", "_id"]).select("text", "todo")
    segments = staged(_segments(text, window, k), "rlz-segments")
    drop(several, todo)
    windows = segments.where("windows is not null").select("anchor", "context", "often", F.posexplode("windows").alias("j", "window"))
    again = staged(windows.groupBy("anchor", "window").agg(F.count("*").alias("c"), F.max("often").alias("often")).where("c > 1 or often").select("anchor", "window"), "rlz-repeated")
    counted = windows.join(again, ["anchor", "window"]).groupBy("anchor", "context").agg(F.expr("bit_or(shiftleft(1L, j))").alias("mask"))
    whole = contexts.where("times > 1").select("anchor", "context", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    masks = counted.unionByName(_parsed(segments, window, k)).unionByName(whole).groupBy("anchor", "context").agg(F.bit_or("mask").alias("mask"))
    masks = staged(masks.where("mask <> 0"), "rlz-masks")
    drop(segments, again, contexts)
    found = occ.join(masks, ["anchor", "context"]).groupBy("_key", "_id").agg(F.collect_set(F.struct("first", "mask")).alias("factors"))
    found = staged(found, "rlz-factors")
    drop(occ, masks)
    return found


def covered(n_words: int, factors, window: int) -> np.ndarray:
    """Which words of a document some repeated window covers."""
    edge = np.zeros(n_words + 1, np.int32)
    for f in factors:
        bits = np.array([f["mask"]], np.int64).view(np.uint8)
        starts = f["first"] + np.flatnonzero(np.unpackbits(bits, bitorder="little"))
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, window: int = WINDOW, keep=(), digest: bool = False) -> DataFrame:
    """Removes each word that a window of `window` words covers which also starts anywhere else in the corpus.

    Returns doc_id, the columns in keep, n_words, n_removed and the kept words joined by one space: their SHA-256 as
    kept_sha256 if digest is set, else as text. A document without a repeated window keeps its text as it is.
    Null and empty texts have no words; repeated rows count as separate documents, so their windows repeat; texts under
    the window's length lose nothing; very long texts are read whole; an empty table gives an empty result; other columns
    are ignored; those in keep must not be called n_words, n_removed or kept.
    """
    keyed = row_key(docs)
    found = duplicate_windows(keyed, window)
    columns = list(dict.fromkeys(["doc_id", *[c for c in keep if c != "text"]]))
    rows = keyed.select("_key", "_id", "text", *columns).join(found, ["_key", "_id"], "left").drop("_key", "_id")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            n_words, n_removed, kept = [], [], []
            for text, factors in zip(x["text"], x["factors"], strict=True):
                words = text.encode().split() if text else []
                gone = covered(len(words), factors, window) if factors is not None else None
                left = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                if digest:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    kept.append(text if len(left) == len(words) else b" ".join(left).decode())
            out = x[columns].copy()
            out["n_words"], out["n_removed"], out["kept"] = n_words, n_removed, kept
            yield out

    out = rows.mapInPandas(run, f"{schema}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256" if digest else "text")
