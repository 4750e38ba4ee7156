"""Byte-level BPE by the ranks of a tiktoken file: texts to ids and back.

A text is cut by a pattern; each different piece of a batch is encoded once. Pieces stand as rows of padded matrices, one for
each power of two of their lengths. In each round every row looks its pairs' ranks up in a hash table and merges its leftmost
pair of least rank; rows close up after a merge and leave the matrix when no pair of theirs has a rank. A row also merges the
other places of that rank in the round, from left to right, if no pair of a lower rank comes of it, as the order cannot
matter then; so a long run of one character needs as many rounds as it has different ranks and not as it has bytes.

Edges: null texts are empty; an empty text has no ids; invalid UTF-8 counts as U+FFFD; special tokens are ordinary text;
repeated rows are encoded each; other columns are ignored unless kept. Batches of texts are cut at BATCH characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of texts encoded together; pieces kept with their ids; bytes of the pieces of a matrix.
BATCH, KEEP, BLOCK = 1_000_000, 300_000, 2_000_000
NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines `base64 rank`; a vocabulary is a fixed size."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}


class PairTable:
    """Open-addressed hash table from pairs of ids to the rank of the token that they make."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        size = 1 << max(4, (3 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # the last of those that meet in a slot stays
            put = free & (self.keys[at] == keys)
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none. Ids below 0 pair with nothing."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Encoder:
    """Ids of pieces. Those seen are kept; when they are many, only those of the texts at hand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs, self.find = ranks, PairTable(ranks), regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        pieces = [self.find(t) for t in texts]
        every = set().union(*pieces)
        if len(self.known) + len(every) > KEEP:
            self.known = {p: self.known[p] for p in every & self.known.keys()}
        self._learn(every - self.known.keys())
        return [b"".join(map(self.known.__getitem__, ps)) for ps in pieces]

    def _learn(self, pieces: set[str]) -> None:
        raws = {p: p.encode() for p in pieces}
        whole = {p: self.ranks[raw].to_bytes(4, "little") for p, raw in raws.items() if raw in self.ranks}
        self.known |= whole
        rest = [p for p in raws if p not in whole]
        sizes = np.array([len(raws[p]) for p in rest])
        order = np.argsort(sizes, kind="stable")
        sizes, start = sizes[order], 0
        while start < len(rest):
            widest = max(8, 1 << (int(sizes[start]) - 1).bit_length())  # a matrix holds pieces of up to this length
            end = min(int(np.searchsorted(sizes, widest, side="right")), start + max(1, BLOCK // widest))
            part = [rest[i] for i in order[start:end].tolist()]
            self.known.update(zip(part, self._merge([raws[p] for p in part])))
            start = end

    def _merge(self, raws: list[bytes]) -> list[bytes]:
        sizes = np.array([len(r) for r in raws])
        ids = np.full((len(raws), int(sizes.max())), -1, np.int32)
        ids[np.arange(ids.shape[1]) < sizes[:, None]] = self.byte[np.frombuffer(b"".join(raws), np.uint8)]
        ranks = np.full(ids.shape, NONE, np.int32)  # of each place and the next
        ranks[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(raws), -1)
        rows, out = np.arange(len(raws)), [b""] * len(raws)
        while True:
            least = ranks.min(axis=1)
            over = least == NONE
            if over.any():  # these rows leave the matrix, which closes up
                left = ids[over]
                ends = (4 * np.cumsum((left >= 0).sum(axis=1))).tolist()
                blob, start = left[left >= 0].astype("<u4").tobytes(), 0
                for r, end in zip(rows[over].tolist(), ends):
                    out[r], start = blob[start:end], end
                rows, ids, ranks, least = rows[~over], ids[~over], ranks[~over], least[~over]
                if not len(rows):
                    return out
                width = int((ids >= 0).sum(axis=1).max())
                ids, ranks = ids[:, :width], ranks[:, :width]
            ids, ranks = self._round(ids, ranks, least)

    def _round(self, ids: np.ndarray, ranks: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        here = ranks == least[:, None]
        first = here.argmax(axis=1)
        many = np.flatnonzero(here.sum(axis=1) > 1)
        new_ids, new_ranks = self._merged(ids, ranks, least, first)
        if len(many):
            places = _alternate(here[many])
            all_ids, all_ranks = self._merged_all(ids[many], ranks[many], least[many], places)
            lower = (all_ranks < least[many, None]).any(axis=1)
            r, c = np.nonzero(places)
            right = np.concatenate([ids[many], np.full((len(many), 2), -1, np.int32)], axis=1)[r, c + 2]
            lower[r[self.pairs(least[many][r], right) < least[many][r]]] = True  # with what stands there before its own merge
            # what comes of one place may come before the next place, else all can go at once
            new_ids[many[~lower]], new_ranks[many[~lower]] = all_ids[~lower], all_ranks[~lower]
        return new_ids, new_ranks

    def _merged(self, ids: np.ndarray, ranks: np.ndarray, least: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows after the merge of one place each, closed up."""
        n, width = ids.shape
        columns, r = np.arange(width), np.arange(n)
        source = columns + (columns > at[:, None])
        source[:, -1] = width - 1
        flat = (source + (r * width)[:, None]).ravel()
        new_ids, new_ranks = ids.ravel()[flat].reshape(n, width), ranks.ravel()[flat].reshape(n, width)
        new_ids[:, -1], new_ranks[:, -1] = np.where(at == width - 1, new_ids[:, -1], -1), NONE
        new_ids[r, at] = least
        wide = np.concatenate([new_ids, np.full((n, 1), -1, np.int32)], axis=1)
        new_ranks[r, at] = self.pairs(least, wide[r, at + 1])
        before = np.flatnonzero(at > 0)
        new_ranks[before, at[before] - 1] = self.pairs(new_ids[before, at[before] - 1], least[before])
        return new_ids, new_ranks

    def _merged_all(self, ids: np.ndarray, ranks: np.ndarray, least: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows after the merge of all places (no two next to each other), closed up."""
        r, c = np.nonzero(places)
        gone = np.zeros(ids.shape, bool)
        gone[r, c + 1] = True
        ids = ids.copy()
        ids[r, c] = least[r]
        moved = np.cumsum(gone, axis=1, dtype=np.int32)
        rr, cc = np.nonzero(~gone)
        to = cc - moved[rr, cc]
        new_ids, new_ranks = np.full(ids.shape, -1, np.int32), np.full(ids.shape, NONE, np.int32)
        new_ids[rr, to], new_ranks[rr, to] = ids[rr, cc], ranks[rr, cc]
        at = c - moved[r, c]
        pad = np.full((len(ids), 1), -1, np.int32)
        wide = np.concatenate([pad, new_ids, pad], axis=1)
        new_ranks[r, at] = self.pairs(wide[r, at + 1], wide[r, at + 2])
        before = at > 0
        r, at = r[before], at[before]
        new_ranks[r, at - 1] = self.pairs(wide[r, at], wide[r, at + 1])
        return new_ids, new_ranks


def _alternate(here: np.ndarray) -> np.ndarray:
    """Of places in a row every second one, from the first."""
    columns = np.arange(here.shape[1])
    before = np.maximum.accumulate(np.where(here, -1, columns[None, :]), axis=1)  # last place that is not one
    return here & ((columns - before) % 2 == 1)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of keep, n_tokens long and ids binary (little-endian unsigned 32-bit integers) for each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        encoder = Encoder(shared.value, pattern)
        for b in batches:
            for i, j in _groups(_sizes(b.column("_text"))):
                part = b.slice(i, j - i)
                ids = encoder.encode([t.decode("utf-8", "replace") if t else "" for t in part.column("_text").to_pylist()])
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), n, pa.array(ids, pa.binary())], names=[*keep, "n_tokens", "ids"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run, f"{types}, n_tokens long, ids binary")


def _sizes(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows with the bytes of their packed ids as the column decoded; null where ids are null."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        tokens = [None] * (max(shared.value.values()) + 1)
        for token, rank in shared.value.items():
            tokens[rank] = token
        for b in batches:
            decoded = [None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.binary())], names=[*b.schema.names, "decoded"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{types}, decoded binary")
