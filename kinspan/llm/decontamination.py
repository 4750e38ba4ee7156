"""Benchmark decontamination by SimHash of item-sized windows, DataFrame functions only.

A document window as long as a benchmark item can only reach the similarity if most of its word shingles are the item's.
So shingles are joined with those of the items first, and one pass over their places in a document gives the window that
shares most weight with the item (a shingle's weight is how often it occurs): the place of a shingle that the item has c times
counts in those windows that hold it and fewer than c earlier places of the same one. If even that window shares too little,
no window is made. The rest get a SimHash; fingerprints are cut into radius + 1 blocks, of which at least one is equal if no
more than `radius` bits differ; windows that agree with their item in a block and lie within the radius are matches.

Blocks are looked up within the items that shingles have led to. Alone they could not lead anywhere: shingles of which 0.8
are shared leave about 10 of 64 bits different, and blocks for a radius that holds nearly all such pairs have three bits.

A document shorter than an item is one window, the whole of it. These and windows in which a shingle of the item repeats are
judged by their exact similarity alone: a slight change of the weight of a frequent shingle can turn a whole fingerprint.
Time is in proportion to the places at which shingles of items stand, however often they repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspan.llm.common import drop, row_key, staged

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
#: A benchmark of up to this many words is broadcast, as shingles of some 50 bytes; a larger one is joined by shuffling.
BROADCAST_WORDS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; w must be a plain column."""
    n = F.size(w) - k
    at = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def simhash(hashes: Column) -> Column:
    """64 bits, each set if it is in over half the hashes."""
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
    bits = [F.when(bit(F.lit(b)) * 2 > F.size(hashes), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for b in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def blocks(fp: Column, radius: int) -> Column:
    """radius + 1 bit ranges of a fingerprint, as (block, value)."""
    m = radius + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value"))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
        ]
    )


def fullest() -> Column:
    """(start, best) of the first window that shares most weight: one pass over where windows gain and lose a place.

    places: (h, at, c), sorted; the place counts from the window on that no longer holds the c-th place of h before it.
    """

    def ends(p, i):
        back = F.get("places", i - p["c"])
        first = F.greatest(p["at"] - F.col("wide"), F.when((i >= p["c"]) & (back["h"] == p["h"]), back["at"] + 1).otherwise(0), F.lit(0))
        return F.array(F.struct(first.alias("s"), F.lit(1).alias("d")), F.struct((p["at"] + 1).alias("s"), F.lit(-1).alias("d")))

    limit = F.col("size") - F.col("n_words")

    def step(x, e):
        better = (e["s"] > x["at"]) & (x["held"] > x["best"]) & (x["at"] <= limit)
        return F.struct(e["s"].alias("at"), (x["held"] + e["d"]).alias("held"), F.when(better, x["held"]).otherwise(x["best"]).alias("best"), F.when(better, x["at"]).otherwise(x["start"]).alias("start"))

    nothing = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.lit(0).alias("best"), F.lit(0).alias("start"))
    return F.aggregate(F.array_sort(F.flatten(F.transform("places", ends))), nothing, step)


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(_key, _id, item_id, start, n_words, similarity): for each document and item the best window, if it is similar.

    Similarity is the shared weight of the shingles over their united weight; windows have as many words as the item, or as
    the document if that has fewer (n_words).
    Items of under five words are one shingle; items without a word match nothing; rows of the benchmark that repeat an
    id and text count once; of equally similar windows the first is given. Null texts have no words; very long texts and
    items are read whole; rows equal in id and text share their matches. Without documents or items the result is empty.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    items = staged(items.select("item_id", F.xxhash64("w").alias("item"), "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k")), "decon-items")
    sizes = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]
    few = (items.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_WORDS
    small = F.broadcast if few else lambda df: df
    # weight that a window must share at least, of n_words - k + 1 shingles and the item's n - k + 1
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n_words") + F.col("n") - 2 * F.col("k") + 2) - F.lit(1e-9))
    by_k = [items.where(F.col("k") == k).withColumn("hashes", shingles(F.col("w"), k)) for k in sizes]
    if not by_k:
        return row_key(docs).select("_key", "_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")).limit(0)
    full = by_k[0]
    for x in by_k[1:]:
        full = full.union(x)
    full = staged(full.drop("w"), "decon-shingles")
    own = full.select("item", "item_id", "n", "k", F.explode("hashes").alias("h")).groupBy("item", "item_id", "n", "k", "h").agg(F.count("*").cast("int").alias("c"))

    d = row_key(docs).select("_key", "_id", words(F.col("text")).alias("w"))
    found = None
    for k in sizes:
        hits = d.select("_key", "_id", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), k)).alias("at", "h"))
        hits = hits.join(small(own.where(F.col("k") == k)), "h")
        found = hits if found is None else found.unionByName(hits)
    places = found.groupBy("_key", "_id", "item", "item_id", "n", "k", "size").agg(F.array_sort(F.collect_set(F.struct("h", "at", "c"))).alias("places"))
    places = places.withColumn("n_words", F.least("n", "size")).withColumn("least", least.cast("int")).where(F.size("places") >= F.col("least"))
    places = staged(places.withColumn("wide", F.col("n_words") - F.col("k")), "decon-places")

    # the best window of each document and item, if it is similar; text is read again for these documents only
    windows = places.withColumn("x", fullest()).where(F.col("x.best") >= F.col("least"))
    union = F.col("n_words") + F.col("n") - 2 * F.col("k") + 2 - F.col("x.best")
    inside = F.transform(F.filter("places", lambda p: p["at"].between(F.col("x.start"), F.col("x.start") + F.col("wide"))), lambda p: p["h"])
    exact = (F.col("n_words") < F.col("n")) | (F.size(F.array_distinct(inside)) < F.size(inside))
    columns = ["_key", "_id", "item", "item_id", "n_words", "k"]
    windows = staged(windows.select(*columns, F.col("x.start").alias("start"), (F.col("x.best") / union).alias("similarity"), exact.alias("exact")).where(F.col("similarity") >= similarity), "decon-candidates")
    drop(places)
    starts = staged(windows.where("not exact").select("_key", "_id", "n_words", "k", "start").distinct(), "decon-starts")
    text = d.join(starts.select("_key", "_id").distinct(), ["_key", "_id"], "left_semi").dropDuplicates(["_key", "_id"])
    cut = starts.join(text, ["_key", "_id"])
    cut = cut.select("_key", "_id", "n_words", "k", "start", F.slice(F.col("w"), F.col("start") + 1, F.col("n_words")).alias("w"))
    of = None
    for k in sizes:
        x = cut.where(F.col("k") == k).withColumn("hashes", shingles(F.col("w"), k)).drop("w")
        of = x if of is None else of.union(x)
    text_windows = staged(of, "decon-windows")
    of = text_windows.withColumn("fp", simhash(F.col("hashes"))).select("_key", "_id", "n_words", "start", "fp")
    held = of.join(windows.where("not exact"), ["_key", "_id", "n_words", "start"])
    probes = held.select(*windows.columns, "fp", F.explode(blocks(F.col("fp"), radius)).alias("x")).select("*", "x.*").drop("x")
    prints = staged(full.select("item", "hashes").dropDuplicates(["item"]).withColumn("item_fp", simhash(F.col("hashes"))).drop("hashes"), "decon-item-prints")
    index = prints.select("item", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("x")).select("*", "x.*").drop("x")
    near = probes.join(small(index), ["item", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = near.select(windows.columns).distinct().union(windows.where("exact"))
    best = pairs.groupBy("_key", "_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.col("n_words").alias("n"))).alias("x"))
    out = staged(best.select("_key", "_id", "item_id", (-F.col("x.s")).alias("start"), F.col("x.n").alias("n_words"), "x.similarity"), "decon-matches")
    drop(windows, starts, text_windows, prints, full, items)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity for each document that holds a benchmark item.

    Repeated rows repeat; other columns of either table are ignored, whatever their names.
    """
    found = matches(docs, benchmark, **how)
    keys = row_key(docs).select("doc_id", "_key", "_id")
    return keys.join(found, ["_key", "_id"]).select("doc_id", "item_id", "start", "n_words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, which must not be called _key or _id."""
    found = matches(docs, benchmark, **how).select("_key", "_id").distinct()
    return row_key(docs).join(found, ["_key", "_id"], "left_anti").select(*docs.columns)
