"""Substring dedup and SimHash near-dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinspan.llm import simhash_dedup, substring_dedup
from kinspan.llm.common import components
from kinspan.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def removed(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def test_op9_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d["doc_id"], *r) for d, r in zip(docs, removed([d["text"] for d in docs], 35)))
    got = sorted(tuple(r) for r in QUERIES["op9_substring_dedup"](spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    assert sum(r[2] for r in got) > 0


def test_op9_edges(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 12, n))
    long = word(60)
    texts = [None, "", "  \n", "a " * 200, long, long, f"{word(20)} {long[:200]} {word(10)}", long + " " + long, word(500), "\x85 \xa0 x"]
    rows = [(i if i != 5 else 4, t, None, None, None) for i, t in enumerate(texts)] + [(None, long, None, None, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("factors", F.lit(1)).withColumn("first", F.lit(2))
    got = sorted((str(r[0]), *r[1:]) for r in substring_dedup.deduplicate(df, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    want = sorted((str(r[0]), *x) for r, x in zip(rows, removed([r[1] for r in rows], 35)))
    assert got == want
    assert substring_dedup.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_anchors_cover_every_window(seed):
    h = np.random.default_rng(seed).integers(0, 9, 300).astype(np.uint64)
    _, _, first, n = substring_dedup.anchors(h, 35, 12)
    assert first[0] == 0 and (first + n == np.append(first[1:], 300 - 35 + 1)).all()


@pytest.mark.parametrize("seed", range(4))
def test_factors_of_a_block_are_all_repeated_windows(seed):
    """Greedy factors of aligned contexts hold just the windows that another context has too."""
    rng = np.random.default_rng(seed)
    window, k = 9, 3
    block = []
    for _ in range(12):
        at, after = int(rng.integers(0, window - k + 1)), int(rng.integers(0, window - k + 1))
        after = max(after, window - k - at)
        words = np.concatenate([rng.integers(0, 2, at), [7, 8, 9], rng.integers(0, 2, after)]).astype(np.int64)
        n = min(len(words) - window + 1, at + 1)
        block.append((words[: n + window - 1], at, n, bool(rng.random() < 0.1)))
    seen = Counter((at - i, tuple(w[i : i + window])) for w, at, n, often in block for i in range(n) for _ in range(2 if often else 1))
    want = [sum(1 << i for i in range(n) if seen[at - i, tuple(w[i : i + window])] > 1) for w, at, n, _ in block]
    assert substring_dedup.factors(block, window, k) == want and any(want)


def test_op9_large_blocks_are_counted(spark, monkeypatch):
    """Anchors with more contexts than a block holds lose nothing."""
    rng = np.random.default_rng(9)
    phrase = [f"p{i}" for i in range(30)]
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3, n)]
    texts = [" ".join(word(12) + phrase + word(12)) for _ in range(400)] + [" ".join(phrase[:20] * 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *x) for i, x in enumerate(removed(texts, 35)))
    for size in (4, 128):
        monkeypatch.setattr(substring_dedup, "BLOCK", size)
        assert sorted(tuple(r) for r in substring_dedup.deduplicate(df, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_op7_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fp(d["text"]) for d in docs]
    ids = [d["doc_id"] for d in docs]
    want = sorted((d, f"{f:016x}", c) for d, f, c in zip(ids, fps, brute_components(ids, fps)))
    assert sorted(tuple(r) for r in QUERIES["op7_simhash_dedup"](spark, sf).collect()) == want
    assert len({c for _, _, c in want}) < len(want)


def test_links_in_dense_and_sparse_sets(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)]
    fps = sorted({centre ^ f for f in flips} | {int(x) for x in rng.integers(0, 1 << 62, 300)})
    df = spark.createDataFrame([(i, simhash_dedup.signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(fps))] == brute_components(list(range(len(fps))), fps)
    pieces = simhash_dedup.links(df.select("fp"), piece=20)
    from kinspan.llm.common import components

    assert components(pieces).count() == components(simhash_dedup.links(df.select("fp"))).count()


def test_op7_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, " \n", "c"), (5, "one", "d"), (5, "one", "d"), (6, "ONE", "e"), (None, "x y z w", "f"), (None, "x y z w", "g"), (7, "two three", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = simhash_dedup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r[0]), (r[1] or "").strip()) for r in kept.collect()) == [("1", ""), ("5", "one"), ("7", "two three"), ("None", "x y z w")]
    assert simhash_dedup.one_of_each(df.limit(0)).count() == 0


def test_thresholds_by_dynamic_programming():
    cost, chosen = simhash_dedup.allocate([{-1: 0, 0: 5, 1: 9}, {-1: 0, 0: 1, 1: 2}, {-1: 0, 0: 9, 1: 40}], 1)
    assert sum(chosen) == 1 and cost == 9 + 2 + 0


def test_components_finish_or_fail(spark):
    chain = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(chain).collect()} == {(i, 0) for i in range(101)}
    assert components(chain.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)


def test_staged_tables_can_be_cleared(spark):
    from kinspan.llm.common import clear, staged

    t = staged(spark.range(3), "t")
    assert t.count() == 3
    clear(spark)
    with pytest.raises(Exception, match="(?i)does not exist|not found|FAILED_READ"):
        t.collect()
