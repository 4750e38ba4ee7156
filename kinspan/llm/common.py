"""What the operators share: staged tables, word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the class [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is a local one if Spark is local too, as in tests."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local_dir()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/kinspan/{sc.applicationId}"


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="kinspan-"))
    return f"file://{_LOCAL[0]}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables, as staged() returned them, from which nothing will be read any more."""
    for t in tables:
        _delete(t.sparkSession, t._staged_at)


def clear(spark: SparkSession) -> None:
    """Deletes this application's staged tables. Results that have not been written yet can't be read any more then."""
    _delete(spark, shared_dir(spark))


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text leaves 1 on division by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def row_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _key and _id, 128 bits by which rows are joined back; rows equal in id and text share them and any result.

    Ids of any type will do.
    """
    name = F.col("doc_id").cast("string")
    return docs.withColumns({"_key": F.xxhash64(name, F.col(text)), "_id": F.xxhash64(F.lit(1), name.isNull(), name, F.col(text))})


def in_share(key, share: float) -> F.Column:
    """A fixed pseudo-random share of the keys."""
    return F.pmod(F.xxhash64(F.lit("share"), key), F.lit(1_000_000)) < int(share * 1_000_000)


# ---- word hashes -------------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number modulo 2^64 and their inverses."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        up, down = np.full(size, _ODD, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    a, b = _POWERS[size]
    return a[:n], b[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for words seen lately; emptied when it has grown."""

    LIMIT = 400_000

    def __missing__(self, word):
        import xxhash

        if len(self) > self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def prefix_sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word spans [start, end): equal sequences have equal hashes wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def window_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:n]) * powers(len(sums))[1][:n])


# ---- components --------------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b), for each node that has an edge.

    Alternates large-star and small-star steps. Each is a minimum per node (combined before the shuffle) and an
    equi-join back, so a node with very many edges needs no task of its own; every round is staged. Raises an error if the
    rounds are used up before it is finished.
    """
    e = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    for _ in range(rounds):
        before, e = e, staged(_small_star(_large_star(e)), "edges")
        drop(before)
        now = e.agg(F.count("*"), F.countDistinct("a")).first()
        # finished: each node points at one smaller node, and no pointed-at node points further
        if now[0] == now[1] and e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components not finished after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    """Connects each node's larger neighbours to the smallest of the node and its neighbours."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Connects each node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return (
        e.join(least, "a")
        .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x"))
        .select("x.*")
        .where("a <> b")
        .distinct()
    )


def shielded(docs: DataFrame, known=("doc_id", "text", "lang", "source", "n_chars")) -> tuple[DataFrame, list]:
    """Renames other columns so that none clashes with an operator's own; the second value selects the old ones back."""
    new = {c: c if c in known else f"_x{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), [F.col(n).alias(c) for c, n in new.items()]
