"""Embedding near-dedup by epsilon grid order (EGO) join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm.common import components, drop, staged

COSINE = 0.93
#: Leading principal dimensions that the grid uses, rows of a sequence interval written as one block, rows compared at once.
GRID, BLOCK, LEAF = 6, 512, 64
#: Blocks that are joined in one task with so many others; directions whose cells bring intervals together.
SUPER, NEAR_BY = 8, 2
#: Slack for rounding in distances, so that nothing within reach is skipped.
SLACK = 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: label and vector there, all components finite, not all zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("label").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(some, F.lit(False)))


def _unit(flat: np.ndarray, n: int, dim: int) -> np.ndarray:
    x = flat.reshape(n, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large and very small components in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _principal(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal directions of the unit vectors, by a [dim, dim] sum over all rows."""

    def run(batches):
        both, n, mean = np.zeros((dim, dim)), 0, np.zeros(dim)
        for b in batches:
            x = np.zeros((b.num_rows, dim))
            for i, v in enumerate(b.column(0).to_pylist()):
                x[i, : len(v)] = _unit(np.array(v, np.float64), 1, len(v))
            both, n, mean = both + x.T @ x, n + len(x), mean + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim + dim + 1)), pa.array(np.concatenate([both.ravel(), mean, [n]]))], ["cell", "v"])

    sums = vectors.select("vec").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(dim * dim + dim + 1)
    for r in sums:
        flat[r["cell"]] = r["v"]
    n = max(flat[-1], 1.0)
    mean = flat[dim * dim : -1] / n
    _, directions = np.linalg.eigh(flat[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))
    return directions[:, ::-1][:, : min(GRID, dim)].copy()


def _placed(distinct: DataFrame, directions: np.ndarray, eps: float) -> DataFrame:
    """Adds the coordinates on the leading directions and the grid cells that order the rows."""
    dim, grid = directions.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            lead = np.zeros((len(x), grid))
            for i, v in enumerate(x["vec"]):
                lead[i] = _unit(np.asarray(v, np.float64), 1, len(v))[0] @ directions[: len(v)]
            x["lead"] = list(lead)
            x["cells"] = list(np.floor(lead / eps).astype(np.int32))
            yield x

    return distinct.mapInPandas(run, "vec_id long, label string, dim int, times long, vec array<double>, lead array<double>, cells array<int>")


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Cuts the grid order into intervals of rows of one label: bounds on the leading dimensions, and the rows packed."""
    ordered = placed.repartitionByRange("label", "dim", "cells", "vec_id").sortWithinPartitions("label", "dim", "cells", "vec_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, []

        def packed(rows):
            nonlocal n
            lead = np.stack(list(rows["lead"]))
            unit = _unit(np.concatenate(list(rows["vec"])).astype(np.float64), len(rows), int(rows["dim"].iloc[0]))
            out = (part << 32 | n, rows["label"].iloc[0], int(rows["dim"].iloc[0]), lead.min(axis=0).tolist(), lead.max(axis=0).tolist(), rows["vec_id"].to_numpy(np.int64).tobytes(), rows["times"].to_numpy(np.int64).tobytes(), lead.tobytes(), unit.tobytes())
            n += 1
            return out

        columns = ["block", "label", "dim", "low", "high", "ids", "times", "lead", "unit"]
        for x in batches:
            x = pd.concat([*held, x]) if held else x
            held, out = [], []
            keys = list(zip(x["label"], x["dim"], strict=True))
            start = 0
            for i in range(1, len(x) + 1):
                if i == len(x) and i - start < block:
                    break
                if i == len(x) or keys[i] != keys[start] or i - start == block:
                    out.append(packed(x.iloc[start:i]))
                    start = i
            if start < len(x):
                held = [x.iloc[start:]]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([packed(held[0])], columns=columns)

    return ordered.mapInPandas(run, "block long, label string, dim int, low array<double>, high array<double>, ids binary, times binary, lead binary, unit binary")


def apart(low_a, high_a, low_b, high_b) -> float:
    """Least squared distance between two boxes."""
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return float((gap * gap).sum())


def ego_join(a: dict, b: dict, same: bool, eps: float, cosine: float, found) -> None:
    """Recursively halves two sequence intervals, drops pairs that lie too far apart, and compares what is left."""

    def go(i, j, k, m):
        la, lb = a["lead"][i:j], b["lead"][k:m]
        if apart(la.min(axis=0), la.max(axis=0), lb.min(axis=0), lb.max(axis=0)) > (eps + SLACK) ** 2:
            return
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero(a["unit"][i:j] @ b["unit"][k:m].T >= cosine)
            if same:
                keep = x + i < y + k
                x, y = x[keep], y[keep]
            if len(x):
                found(x + i, y + k)
            return
        if j - i >= m - k:
            h = (i + j) // 2
            halves = ((i, h, k, m), (h, j, k, m))
        else:
            h = (k + m) // 2
            halves = ((i, j, k, h), (i, j, h, m))
        for p in halves:
            if not same or p[0] < p[3]:  # below the diagonal nothing is new
                go(*p)

    go(0, len(a["ids"]), 0, len(b["ids"]))


def near_blocks(bounds: DataFrame, grid: int, eps: float) -> DataFrame:
    """(block, block_b, super, super_b): pairs of blocks of one label whose boxes lie within reach, block <= block_b.

    Intervals of SUPER blocks in sequence are brought together first, by the cells of the first directions that their boxes
    touch; only blocks of intervals within reach are compared.
    """
    where = F.floor(F.col("block") / SUPER).cast("long")
    of = bounds.withColumn("super", F.xxhash64("label", "dim", where))
    edge = lambda f, c: F.array(*[f(F.get(c, i)) for i in range(grid)]).alias(c)
    upper = staged(of.groupBy("super", "label", "dim").agg(edge(F.min, "low"), edge(F.max, "high")), "ego-intervals")
    cell = lambda c: F.floor(c / eps)
    axes = range(min(NEAR_BY, grid))
    left, right = upper, upper.select(*[F.col(c).alias(f"{c}_b") for c in upper.columns])
    for i in axes:
        left = left.withColumn(f"cell{i}", F.explode(F.sequence(cell(F.get("low", i)) - 1, cell(F.get("high", i)) + 1)))
        right = right.withColumn(f"cell{i}", F.explode(F.sequence(cell(F.get("low_b", i)), cell(F.get("high_b", i)))))
    gap = F.aggregate(
        F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low_b", "high_b"), lambda x, y: F.greatest(F.lit(0.0), x["low"] - y["high_b"], y["low_b"] - x["high"])),
        F.lit(0.0),
        lambda s, g: s + g * g,
    )
    reach = gap <= (eps + SLACK) ** 2
    keys = [f"cell{i}" for i in axes]
    near = left.join(right.withColumnsRenamed({"label_b": "label", "dim_b": "dim"}), ["label", "dim", *keys]).where((F.col("super") <= F.col("super_b")) & reach)
    near = staged(near.select("super", "super_b").distinct(), "ego-near")
    a, b = of.select("block", "low", "high", "super"), of.select(*[F.col(c).alias(f"{c}_b") for c in ("block", "low", "high", "super")])
    # of an interval with itself each pair of blocks is taken once
    once = (F.col("super") != F.col("super_b")) | (F.col("block") <= F.col("block_b"))
    pairs = staged(near.join(a, "super").join(b, "super_b").where(reach & once).select("block", "block_b", "super", "super_b"), "ego-pairs")
    drop(upper, near)
    return pairs


def _joined(blocks: DataFrame, pairs: DataFrame, cosine: float, eps: float) -> DataFrame:
    """For each pair of intervals: links added per vector, and a few links that connect what is linked in them.

    A block is sent once to each interval that has a partner of it; such a task holds 2 * SUPER blocks at most.
    """
    key = ["super", "super_b"]
    asked = pairs.groupBy(*key, "block").agg(F.collect_list("block_b").alias("others"))
    also = pairs.select(*key, F.col("block_b").alias("block"), F.array().cast("array<long>").alias("others"))
    wanted = asked.unionByName(also).groupBy(*key, "block").agg(F.flatten(F.collect_list("others")).alias("others"))
    rows = wanted.join(blocks.select("block", "ids", "times", "lead", "unit"), "block")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        side, place = {}, {}
        for r in x.itertuples(index=False):
            n = len(r.ids) // 8
            side[r.block] = {"ids": np.frombuffer(r.ids, np.int64), "times": np.frombuffer(r.times, np.int64), "lead": np.frombuffer(r.lead).reshape(n, -1), "unit": np.frombuffer(r.unit).reshape(n, -1)}
            place[r.block] = sum(len(s["ids"]) for s in side.values()) - n
        ids = np.concatenate([s["ids"] for s in side.values()])
        count, parent, edges = np.zeros(len(ids), np.int64), list(range(len(ids))), []

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for r in x.itertuples(index=False):
            for other in r.others:
                a, b, at_a, at_b = side[r.block], side[other], place[r.block], place[other]

                def found(i, j, a=a, b=b, at_a=at_a, at_b=at_b):
                    np.add.at(count, i + at_a, b["times"][j])
                    np.add.at(count, j + at_b, a["times"][i])
                    for p, q in zip((i + at_a).tolist(), (j + at_b).tolist(), strict=True):
                        s, t = root(p), root(q)
                        if s != t:
                            parent[s] = t
                            edges.append((p, q))

                ego_join(a, b, r.block == other, eps, cosine, found)
        some = count > 0
        links = pd.DataFrame({"a": [int(ids[p]) for p, _ in edges], "b": pd.array([int(ids[q]) for _, q in edges], "Int64"), "n": 0})
        counts = pd.DataFrame({"a": ids[some], "b": pd.array([None] * int(some.sum()), "Int64"), "n": count[some]})
        return pd.concat([counts, links]) if len(links) else counts

    return rows.groupBy(*key).applyInPandas(run, "a long, b long, n long")


def link(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors of one label and length link at a cosine of at least `cosine`, in double precision. Equal vectors are joined
    once and count as often as they occur. Vectors that are null, zero or hold null or non-finite components, and rows
    without a label, have no links and are their own component. Rows repeated under one vec_id count as vectors of their
    own in n_links but share a component. A null vec_id names nothing: such a vector links and counts, and its component goes
    by the others' ids. Ids of any type are compared in their order. Labels of any type are compared as they are. Vectors of any length will do; one
    task holds 2 * SUPER blocks of them. An empty table gives an empty result; extra columns are ignored.
    """
    text_of = lambda c: (c + F.lit(0.0) if vectors.schema["label"].dataType.simpleString() in ("float", "double") else c).cast("string")
    label, one_zero = text_of(F.col("label")).alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec")
    v = usable(vectors).select("vec_id", label, one_zero)
    distinct = v.groupBy("label", "vec").agg(F.min("vec_id").alias("own"), F.count("*").alias("times"))
    # a number of its own, as ids may be null and of any type; written, so it stays what it is
    distinct = staged(distinct.select(F.monotonically_increasing_id().alias("vec_id"), "own", "label", F.size("vec").alias("dim"), "times", "vec"), "ego-distinct")
    of = vectors.select("vec_id", label, one_zero)
    dim = distinct.agg(F.max("dim")).first()[0]
    if dim is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    directions = _principal(distinct, dim)
    blocks = staged(_blocks(_placed(distinct.drop("own"), directions, eps), block), "ego-blocks")
    pairs = near_blocks(blocks.select("block", "label", "dim", "low", "high"), directions.shape[1], eps)
    found = staged(_joined(blocks, pairs, cosine, eps), "ego-links")
    drop(blocks, pairs)
    n = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null").select("a", "b"))
    of_class = distinct.select("vec_id", "own").join(comp, F.col("vec_id") == F.col("node"))
    least = of_class.groupBy("component").agg(F.min("own").alias("least"))
    comp = comp.join(least, "component")
    classes = distinct.join(n, distinct["vec_id"] == n["a"], "left").join(comp, distinct["vec_id"] == comp["node"], "left")
    classes = classes.select(
        F.col("label").alias("_label"),
        F.col("vec").alias("_vec"),
        (F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"),
        F.coalesce("least", "own").alias("component_id"),
    )
    classes = staged(classes, "ego-classes")
    drop(distinct, found)
    out = of.join(classes, (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
