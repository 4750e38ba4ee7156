"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.llm.common import SPACE, drop, staged

#: monotonically_increasing_id holds the partition above this bit.
_PART = 33


def _turns(sizes: DataFrame, weights) -> DataFrame:
    """Adds w: sources by code point, null last, take the weights in turn. Sorted in ranges; only their lengths are collected."""
    spark, order = sizes.sparkSession, (F.col("source").isNull(), F.col("source"))
    ranged = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    s = staged(ranged.withColumn("part", F.shiftright("row", _PART)), "mix-sources")
    offset, rows = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in s.groupBy("part").count().collect()):
        rows.append((part, offset))
        offset += n
    offsets = F.broadcast(spark.createDataFrame(rows, "part long, offset long"))  # a row for each partition
    at = (F.col("offset") + F.col("row").bitwiseAND((1 << _PART) - 1)) % len(weights)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return s.join(offsets, "part").select("source", "source_size", F.get(turn, at.cast("int")).alias("w"))


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): shares a budget over the sources by weight, none above cap times its size.

    sizes has source and source_size, one row per source. What sources that are full leave is shared again by weight until
    none is above its cap: each round is one sum over all sources. An empty table has no targets.
    """
    s = _turns(sizes, weights)
    most = F.lit(cap) * F.col("source_size")
    budget, n = s.agg(share * F.sum("source_size"), F.count("*")).first()
    level, full = 0.0, -1
    while n:
        over = most / F.col("w") < level
        taken, left, now = s.agg(
            F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)), F.count(F.when(over, 1))
        ).first()
        if now == full or not left:
            break
        level, full = (budget - taken) / left, now
    return s.select("source", "source_size", F.least(most, F.lit(float(level)) * F.col("w")).cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, keep=()) -> DataFrame:
    """Whole copies of documents per source, so that each source's words come near its target.

    Every document is taken floor(target / size of source) times, and once more if its hash lies below the source's
    threshold. Thresholds come from two nested histograms of words by (source, hash bucket): only the boundary bucket is
    split further, and only different documents in the last boundary bucket are ordered. Returns doc_id, the columns in
    keep, size, source_size, target, copies and taken. A source misses its target by half a document at most.

    Null texts have size 0 and are taken as often as others of their source; null sources are one source; null ids hash
    as empty text. Repeated rows are separate documents, of which as many are taken as fit; documents that tie in the hash
    go by id, size and a hash of the text, and which of fully equal rows are taken is arbitrary. Texts of any length are
    counted whole; an empty table gives an empty result. Extra columns are ignored unless named in keep.
    """
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = lambda start, n: F.conv(F.substring(h, start, n), 16, 10).cast("long")
    size = F.coalesce(F.size(F.filter(F.split(F.col("text"), SPACE), lambda w: w != "")), F.lit(0))
    d = staged(
        docs.select(
            "doc_id",
            "source",
            *[F.col(c) for c in keep if c not in ("doc_id", "source")],
            F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias("size"),
            number(1, 3).alias("b1"),
            number(4, 3).alias("b2"),
            F.struct(number(7, 9).alias("rest"), F.col("doc_id").isNull().alias("isnull"), F.col("doc_id").alias("id"), F.length("text").alias("chars"), F.xxhash64("text").alias("like")).alias("place"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    first = staged(d.groupBy("source", "b1").agg(F.sum("size").alias("words")), "mix-histogram")
    per_source = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    per_source = per_source.withColumn("ratio", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    per_source = per_source.withColumn("whole", F.least(F.floor("ratio"), F.lit(int(cap))).cast("int"))
    per_source = staged(per_source.withColumn("want", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "mix-targets")

    boundary = _boundary(first, per_source.select("source", "want"), "b1")
    second = _same(d.drop("place"), boundary.select("source", "b1"), "source", "b1").groupBy("source", "b2").agg(F.sum("size").alias("words"))
    edge2 = _boundary(second, boundary.select("source", F.col("rest_want").alias("want")), "b2")
    edge = _same(boundary.select("source", F.col("b1").alias("t1")), edge2.select("source", F.col("b2").alias("t2"), "rest_want"), "source", how="left")
    edge = staged(edge, "mix-edges")
    drop(first)
    last = _same(d, edge.select("source", F.col("t1").alias("b1"), F.col("t2").alias("b2"), "rest_want"), "source", "b1", "b2")
    # rows that repeat are counted before they are ordered
    last = last.groupBy("source", "rest_want", "place", "size").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source").orderBy("place", "size")
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("room", F.col("rest_want") - before)
    # a document is taken if half of it or more is still wanted
    fit = F.when(F.col("size") == 0, F.when(F.col("room") >= 0, F.col("n")).otherwise(0)).otherwise(F.floor(F.col("room") / F.col("size") + 0.5))
    last = last.withColumn("fit", F.greatest(F.lit(0), F.least("n", fit)).cast("long")).where("fit > 0")
    cut = staged(last.groupBy("source").agg(F.max(F.struct("place", "size", "fit", "n")).alias("cut")), "mix-cuts")
    equal = _row_limit(d, edge, cut)
    per_source = _same(_same(per_source, edge.select("source", "t1", "t2"), "source", how="left"), cut, "source", how="left")
    per_source = staged(_same(per_source, equal, "source", how="left"), "mix-thresholds")
    out = _same(d, per_source, "source", how="left")
    here, there = F.struct("place", "size"), F.struct("cut.place", "cut.size")
    inside = (here < there) | ((here == there) & (F.col("last_row").isNull() | (F.col("row") <= F.col("last_row"))))
    below = (
        (F.col("b1") < F.col("t1"))
        | ((F.col("b1") == F.col("t1")) & (F.col("b2") < F.col("t2")))
        | ((F.col("b1") == F.col("t1")) & (F.col("b2") == F.col("t2")) & F.col("cut").isNotNull() & F.coalesce(inside, F.lit(False)))
    )
    copies = F.col("whole") + F.when(F.coalesce(below, F.lit(False)) & (F.col("whole") < int(cap)), 1).otherwise(0)
    return out.select("doc_id", *[c for c in keep if c != "doc_id"], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _row_limit(d: DataFrame, edge: DataFrame, cut: DataFrame) -> DataFrame:
    """(source, last_row): where only some of the rows that repeat at a source's cut are taken, the last of them.

    They are counted per written part; rows are numbered only in the part where the count passes what fits.
    """
    some = cut.where("cut.fit < cut.n").select("source", F.col("cut.place").alias("at"), F.col("cut.size").alias("at_size"), F.col("cut.fit").alias("want"))
    some = _same(some, edge.select("source", "t1", "t2"), "source")
    rows = _same(d.select("source", "b1", "b2", "place", "size", "row"), some, "source")
    rows = rows.where((F.col("b1") == F.col("t1")) & (F.col("b2") == F.col("t2")) & F.col("place").eqNullSafe(F.col("at")) & (F.col("size") == F.col("at_size")))
    rows = rows.select("source", "want", "row", F.shiftright("row", _PART).alias("part"))
    parts = rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.any_value("want").alias("want"))
    run = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("upto", F.sum("n").over(run)).where("upto >= want").withColumn("left", F.col("want") - F.col("upto") + F.col("n"))
    part = parts.groupBy("source").agg(F.min(F.struct("part", "left")).alias("x")).select("source", "x.part", "x.left")
    number = F.row_number().over(Window.partitionBy("source").orderBy("row"))
    return _same(rows.select("source", "row", "part"), part, "source", "part").withColumn("number", number).where(F.col("number") == F.col("left")).select("source", F.col("row").alias("last_row"))


def _same(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Joins on keys where null equals null; keeps a's keys."""
    b = b.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in b.columns])
    on = None
    for k in keys:
        same = a[k].eqNullSafe(b[f"_{k}"]) if k == "source" else a[k] == b[f"_{k}"]
        on = same if on is None else on & same
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])


def _boundary(histogram: DataFrame, want: DataFrame, bucket: str) -> DataFrame:
    """(source, bucket, rest_want): the bucket in which a source's running words pass what is wanted of it."""
    run = Window.partitionBy("source").orderBy(bucket)
    h = _same(histogram, want, "source").withColumn("upto", F.sum("words").over(run))
    h = h.where((F.col("upto") > F.col("want"))).withColumn("before", F.col("upto") - F.col("words"))
    first = h.groupBy("source").agg(F.min(F.struct(bucket, (F.col("want") - F.col("before")).alias("rest_want"))).alias("x"))
    return first.select("source", f"x.{bucket}", "x.rest_want")
