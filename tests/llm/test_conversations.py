"""Prefix trie and structure repair against brute force; byte-level BPE against the library whose file it reads."""

import hashlib
import random
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from kinspan.llm import byte_bpe, prefix_trie, turn_repair
from kinspan.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string"


# ---- prefix trie --------------------------------------------------------------------------------------------------


def nodes(seqs):
    """Rows of NODE of {id: [(key, size), ...]} by listing every beginning."""
    members, ends, sizes = defaultdict(list), defaultdict(list), {(): 0}
    for c, s in seqs.items():
        path = tuple(k for k, _ in s)
        for d in range(len(s) + 1):
            members[path[:d]].append(c)
            sizes[path[:d]] = s[d - 1][1] if d else 0
        ends[path].append(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    kids = {p: sum(len(x) == len(p) + 1 for x in below[p]) for p in members}
    return sorted(
        (min(members[p]), len(p), min(members[p[:-1]]) if p else -1, len(members[p]), kids[p], sum(not kids[x] for x in below[p]),
         sum((len(members[x]) - 1) * sizes[x] for x in below[p]), hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p in members
    )


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_over_many_ranges(spark, seed):
    rng = random.Random(seed)
    seqs = {}
    for c in range(400):
        n = rng.choice([0, 1, 2, 3, 5, 9])
        seqs[c - 60] = [(bytes([rng.choice([1, 1, 1, 2, 3])]) * prefix_trie.KEY, rng.randint(0, 5)) for _ in range(n)]
    for c in rng.sample(sorted(seqs), 130):
        seqs[c] = seqs[-60] if seed else [(b"x" * prefix_trie.KEY, 4)] * 12
    sizes = defaultdict(int)  # a key has one size
    seqs = {c: [(k, sizes.setdefault(k, n)) for k, n in s] for c, s in seqs.items()}
    df = spark.createDataFrame([(c, [k for k, _ in s], [n for _, n in s]) for c, s in seqs.items()], "conv_id long, keys array<binary>, sizes array<int>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert got(prefix_trie.trie(df)) == nodes(seqs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_loser_tree_shares_no_turn_twice():
    rng = random.Random(5)
    rows = [(b"".join(rng.choice([b"a" * 16, b"b" * 16]) for _ in range(rng.randint(0, 6))), c, []) for c in range(500)]
    runs = [prefix_trie.sorted_run(rows[i : i + 37]) for i in range(0, 500, 37)]
    merged = list(prefix_trie.LoserTree(runs))
    assert [(x[1], x[2]) for x in merged] == sorted(r[:2] for r in rows)
    assert all(b[0] == prefix_trie.shared(a[1], b[1]) for a, b in zip(merged, merged[1:]))
    assert list(prefix_trie.LoserTree([])) == []


def test_op11_edges(spark):
    rows = [(100, 0, "user", "a"), (100, None, None, None), (100, 1, "u", "ser"), (101, 0, "x", "y"), (102, 3, "user", "a"), (102, 3, "user", "a"), (None, 0, "user", "a"), (-5, 0, "user", "é😀"), (7, 0, "us", "era")]
    df = spark.createDataFrame(rows, ROWS).withColumns({"key": F.lit(1), "keys": F.lit(2)})
    seqs = prefix_trie.sequences(df)
    assert {r[0]: list(r[2]) for r in seqs.collect()} == {100: [0, 1, 3], 101: [1], 102: [1, 1], -5: [2], 7: [3]}
    found = prefix_trie.trie(prefix_trie.with_shared_start(seqs, F.col("conv_id") - F.col("conv_id") % 100, F.lit(2), 2))
    root = [r for r in found.collect() if r["depth"] == 0]
    # 101 and 102 have the two first turns of 100, -5 and 7 have none of their own after two
    assert [(r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in root] == [(-5, 5, 1, 1, 2)]
    assert root[0]["ends_sha256"] == hashlib.sha256(b"-5,7").hexdigest()
    assert prefix_trie.trie(prefix_trie.sequences(df.limit(0))).count() == 0


# ---- structure repair ---------------------------------------------------------------------------------------------


def repaired(rows):
    """Cost, audit and turns by trying every edit from every state."""
    seen, kinds = set(), []
    for role, text in rows:
        visible = text.strip(turn_repair.SPACES)
        kinds.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
        if inserted < 3:
            for x in "ua":
                if (q, x) in step:
                    c, a, out = best(i, x, inserted + 1)
                    found.append((c + 5, "I" + a, ((full[x], ""), *out)))
        if i < len(rows):
            (role, text), kind = rows[i], kinds[i]
            c, a, out = best(i + 1, q, 0)
            found.append((c + 2, "D" + a, out))
            if kind in ("", "truncated"):
                more = 5 * (kind == "truncated")
                if (q, role[:1]) in step:
                    c, a, out = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, ((role, text), *out)))
                for x in "ua":
                    if (q, x) in step:
                        c, a, out = best(i + 1, x, 0)
                        found.append((c + more + 1, "R" + a, ((full[x], text), *out)))
        return min(found) if found else (10**9, "", ())

    return (*(kinds.count(k) for k in turn_repair.FAULTS), *best(0, "", 0))


def test_repair_equals_trying_all(spark):
    rng = random.Random(2)
    rows = []
    for c in range(300):
        for t in range(rng.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, rng.choice([t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "ua"]), rng.choice(["a.", "b?", "c", " ", "", "d!\n", f"{t}.", f"{t}. "])))
    want = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for c in range(300):
        own = sorted((r for r in rows if r[0] == c), key=order)
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum((a[2][:1], b[2][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(own, own[1:]))
        blank, duplicate, truncated, cost, audit, out = repaired([(r[2], r[3]) for r in own])
        want[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, list(out))
    found = turn_repair.repair(spark.createDataFrame(rows, ROWS).withColumn("end", F.lit("x"))).collect()
    assert {r[0]: (*r[1:8], [tuple(t) for t in r[8]]) for r in found} == want
    assert len({len(w[7]) for w in want.values()}) > 3


def test_op12_equals_trying_all(spark, sf):
    """The query over the whole table, damaged by another reading of the rule."""
    import zlib

    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want, groups = {}, defaultdict(list)
    for c, t, role, text in table.select("conv_id", "turn", "role", "text").collect():
        how = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if how == 1 else "".join(x for x in text if x not in ".!?") if how == 2 else text
        groups[c] += [(t, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    for c, rows in groups.items():
        *counts, cost, audit, out = repaired([r[1:] for r in sorted(rows)])
        want[c] = (*counts, cost, audit, hashlib.sha256("\n".join(":".join(x) for x in out).encode()).hexdigest())
    found = QUERIES["op12_turn_repair"](spark, sf).select("conv_id", *turn_repair.FAULTS, "cost", "audit", "repaired_sha256").collect()
    assert {r[0]: tuple(r[1:]) for r in found} == want


def test_repair_edges(spark):
    rows = [(None, None, None, None), (1, 0, "user", None), (2, 5, "user", "Hello."), (2, 1, None, "x")]
    df = spark.createDataFrame(rows, ROWS)
    found = {r["conv_id"]: r for r in turn_repair.repair(df).collect()}
    assert [found[None][c] for c in ("gaps", "blank", "cost", "audit", "repaired")] == [0, 1, 2, "D", []]
    assert found[2]["gaps"] == 3 and found[2]["audit"] == "DD" and found[2]["cost"] == 4
    gone = turn_repair.repair(df.withColumn("there", F.lit(False))).collect()
    assert len(gone) == 3 and all(tuple(r[1:]) == (0, 0, 0, 0, 0, 0, "", []) for r in gone)
    assert turn_repair.repair(df.limit(0)).count() == 0
    long = spark.range(3000).selectExpr("9L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat(id, '.') text")
    assert turn_repair.repair(long).first()["audit"] == "K" * 3000


# ---- byte-level BPE -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op13_equals_library(spark, sf, library):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"])
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op13_byte_bpe"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_bpe_of_odd_texts(ranks, library):
    rng = random.Random(4)
    some = [" ", "  ", "\n", "\t", "a", "ab", " the", "=", "--", "é", "中", "😀", "1", "'s", "'", "_", "́", " ", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 50))) for _ in range(4000)]
    texts += [x * n for x in (" ", "=", "ab", "aab", "abcde", "é", "ha") for n in (31, 32, 33, 3000)]
    texts += ["".join(rng.choices("abcdefgh", k=4000)), ""]
    found = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == library.encode_ordinary_batch(texts)


def test_bpe_one_place_at_a_time_where_order_matters():
    """A merge makes a pair of a lower rank, so places of one rank can't be merged at once."""
    tokens = {bytes([i]): i for i in range(256)} | {b"bca": 300, b"bc": 400, b"ca": 500, b"bcabc": 299, b"aa": 600, b"aaa": 598}
    library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=tokens, special_tokens={})
    encoder = byte_bpe.Encoder(tokens, r"\w+")
    rng = random.Random(1)
    texts = ["bcabcabcbc", "bcbcabc" * 9, "a" * 57] + ["".join(rng.choices("abc", k=rng.randint(1, 70))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_tables(spark, ranks):
    rows = [(1, None, 5), (1, "", 6), (None, "Hello, world", 7), (3, "Hello, world", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    found = byte_bpe.decode(byte_bpe.encode(df.drop("ids"), ranks, public_tokenizers.PATTERN), ranks).collect()
    assert [(r["doc_id"], r["n_tokens"], bytes(r["decoded"])) for r in found] == [(1, 0, b""), (1, 0, b""), (None, 3, b"Hello, world"), (3, 3, b"Hello, world")]
    broken = df.limit(1).select(F.lit(8).alias("doc_id"), F.expr("cast(x'61FF62' as string)").alias("text"))
    assert bytes(byte_bpe.decode(byte_bpe.encode(broken, ranks, public_tokenizers.PATTERN), ranks).first()["decoded"]).decode() == "a�b"
    assert byte_bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), ranks).first()["decoded"] is None
