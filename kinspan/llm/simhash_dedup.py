"""SimHash near-dedup by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm.common import components, drop, shielded, staged

RADIUS = 3
#: Rows of a bucket that one task compares at a time; larger buckets are split into pairs of pieces.
PIECE = 1024
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is set if it is in over half the XXH64 hashes (seed 42) of the word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 65_536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + 65_536], stops[i : i + 65_536], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > n), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep=()) -> DataFrame:
    """doc_id, the columns in keep, and fp: the fingerprint as a signed long. Null, empty and blank texts have 0."""
    columns = list(dict.fromkeys(["doc_id", *[c for c in keep if c != "text"]]))
    kept = columns + ["text"] * ("text" in keep)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(fp)], [*kept, "fp"])

    return docs.select(*columns, "text").mapInArrow(run, schema)


# ---- the plan: which bits form which part, and how many of each part's bits may differ ---------------------------


def _together(fps: DataFrame) -> np.ndarray:
    """How often each two bits are set together, over all fingerprints; [64, 64] and the number of fingerprints."""

    def run(batches):
        both = np.zeros((64, 64), np.int64)
        for b in batches:
            x = np.asarray(b.column(0)).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(both.ravel())], ["cell", "n"])

    sums = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4096)
    for r in sums:
        out[r["cell"]] = r["n"]
    return out.reshape(64, 64)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Puts correlated bits into the same part, parts of near equal size."""
    p = together / max(n, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    corr = np.abs((p - np.outer(mean, mean)) / np.outer(spread, spread))
    free, out = set(range(64)), []
    for i in range(parts):
        size = 64 * (i + 1) // parts - 64 * i // parts
        seed = max(sorted(free), key=lambda b: sum(corr[b, c] for c in free if c != b))
        part = [seed]
        free.remove(seed)
        while len(part) < size:
            best = max(sorted(free), key=lambda b: sum(corr[b, c] for c in part))
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least cost, by dynamic programming; -1 leaves a part out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t, x in cost.items():
                if spent + t not in step or c + x < step[spent + t][0]:
                    step[spent + t] = (c + x, [*chosen, t])
        best = step
    return best[total]


def masks(part: list[int], most: int) -> list[int]:
    """All changes of at most `most` bits of a part."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(part, n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan(fps: DataFrame, radius: int = RADIUS, choices=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part probed, the cheapest of several numbers of parts by estimated candidates.

    Two fingerprints within the radius differ by no more than its threshold in some part if the thresholds add up to
    radius - parts + 1. How many pairs agree on a part is counted over all fingerprints; a threshold above 0 multiplies
    that by the number of changes. An estimate only moves the cost: any plan finds every link.
    """
    together = _together(fps)
    n = fps.count()
    options = {m: group_bits(together, n, m) for m in choices}
    every = [(m, i, part) for m, parts in options.items() for i, part in enumerate(parts)]
    value = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in part)))).alias("v")) for m, i, part in every]))
    sizes = fps.select(value.alias("x")).groupBy("x.m", "x.i", "x.v").count().groupBy("m", "i").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    pairs = {(r["m"], r["i"]): r["pairs"] for r in sizes}
    best = None
    for m, parts in options.items():
        costs = []
        for i, part in enumerate(parts):
            cost = {-1: 0.0}
            for t in range(0, radius + 1):
                changes = sum(comb(len(part), j) for j in range(t + 1))
                if changes <= 600:
                    cost[t] = (pairs.get((m, i), 0.0) + n / 2) * changes + 20.0 * n * changes
            costs.append(cost)
        c, chosen = allocate(costs, radius - m + 1)
        if best is None or c < best[0]:
            best = (c, [(part, t) for part, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


# ---- probing and verifying ---------------------------------------------------------------------------------------


def forest(x: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Links within the radius that hold a set of fingerprints together: from each one reached, to those not yet reached."""
    out, rest = [], x
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                hits = rest[near]
                out.append((at, hits))
                frontier.extend(hits)
                rest = rest[~near]
    return out


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): enough verified links of each bucket to connect what is within the radius in it. rows: sorted by bucket."""

    def run(batches):
        last_key, last = None, []

        def done(groups):
            a, b = [], []
            for g in groups:
                g = np.unique(g)
                for at, hits in forest(g.view(np.uint64), radius):
                    a.append(np.full(len(hits), at, np.uint64))
                    b.append(hits)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

        for batch in batches:
            key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])
            fp = np.asarray(batch.column(3)).astype(np.int64)
            if not len(fp):
                continue
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            groups = np.split(fp, cut)
            first, final = tuple(key[:, 0]), tuple(key[:, -1])
            if last_key is not None and first != last_key:
                yield from done([np.concatenate(last)])
                last = []
            last.append(groups[0])
            if len(groups) > 1:
                yield from done([np.concatenate(last), *[g for g in groups[1:-1] if len(g) > 1]])
                last = [groups[-1]]
            last_key = final
        if last:
            yield from done([np.concatenate(last)])

    return rows.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """(a, b): verified links between distinct fingerprints (column fp) that connect all that is within the radius."""
    probes = []
    for i, (part, t) in enumerate(plan(fps, radius)):
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in part))))
        probes += [F.struct(F.lit(i).alias("part"), own.bitwiseXOR(F.lit(signed(m))).alias("value")) for m in masks(part, t)]
    rows = fps.select("fp", F.explode(F.array(*probes)).alias("x")).select("x.part", "x.value", "fp")
    sizes = rows.groupBy("part", "value").count().where("count > 1")
    sizes = staged(sizes.select("part", "value", F.ceil(F.col("count") / piece).cast("int").alias("pieces")), "gph-buckets")
    rows = rows.join(sizes, ["part", "value"])
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    rows = rows.select("part", "value", "pieces", "fp", own.alias("own"), other.alias("other"))
    pair = F.least("own", "other") * F.col("pieces") + F.greatest("own", "other")
    rows = rows.select("part", "value", pair.alias("pair"), "fp").repartition("part", "value", "pair").sortWithinPartitions("part", "value", "pair")
    return _links(rows, radius)


def near_duplicates(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds component_id to a table of doc_id and fp: the smallest doc_id reachable over links, the document's own too.

    Documents with one fingerprint are linked without comparison, so copies in any number cost no pairs; only distinct
    fingerprints are probed. A component in which every id is null has a null component_id. Repeated rows stay.
    """
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "gph-distinct")
    comps = components(links(distinct, radius))
    of = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
    of = staged(of.select("fp", "least", F.coalesce("component", "fp").alias("component")), "gph-members")
    least = staged(of.groupBy("component").agg(F.min("least").alias("component_id")), "gph-components")
    classes = staged(of.join(least, "component").select("fp", "component", "component_id"), "gph-classes")
    drop(distinct, of, least)
    return fps.join(classes, "fp")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest id; a null id counts as largest.

    A group whose ids are all null, and rows repeated under one id in one group, keep one row.
    """
    docs, back = shielded(docs)
    fps = staged(fingerprints(docs, docs.columns).withColumn("_row", F.monotonically_increasing_id()), "gph-documents")
    classes = near_duplicates(fps.select("doc_id", "fp", "_row"), radius)
    # the row that stays is chosen by its number, before texts are moved
    chosen = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("_row").alias("_row")).select("_row")
    return fps.join(staged(chosen, "gph-chosen"), "_row", "left_semi").select(*back)
