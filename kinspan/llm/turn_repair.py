"""Least-cost repair of the structure of conversations, by a weighted automaton that is made deterministic as it is needed.

A conversation should have the roles system?, then user and assistant in turn. Edits keep, rerole, delete and insert turns at
fixed costs. Read from the last row to the first, the least costs of what is left to do, from each of the four states of
that pattern, are a vector; less its smallest value it is one of finitely many, which become the states of a deterministic
automaton. A state and a row's symbol give the next state and a weight once, kept in a table; from then on a scan over the
table, all conversations of a batch side by side, gives the costs. Each entry also holds, for each state of the pattern, the
tight edit that comes first in ASCII order, so the way back through the vectors, from the first row to the last, writes the
cheapest audit that is least.

Rows are shuffled by conversation once and sorted; a task holds one conversation and a batch of others at a time. Edges: a
null conv_id is one conversation; turns are ordered nulls first, ties by role and text; null roles and texts are empty (as
damage() makes them, one space); repeated rows are duplicates; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
#: Costs of an edit, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of system?(user assistant)+: nothing read, after system, after user, after assistant; where user and assistant lead; by role.
GO_ON = (2, 2, 3, 2)
BY_ROLE = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
FINAL = (0, 3)
NAMES = {2: "user", 3: "assistant"}
#: Symbols: role's place in "sua" or 3, plus 4 if truncated; MUST_GO for blank rows and duplicates.
MUST_GO, SYMBOLS = 8, 9
FAULTS = ("blank", "duplicate", "truncated")
OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role string, text string>>"


class Automaton:
    """Transition table from cost vectors and symbols, filled as they come up. State 0 is the end of a conversation."""

    def __init__(self):
        self.ids, self.vectors, self.letters, self.codes = {}, [], [], {}
        self.next, self.weight = np.full((0, SYMBOLS), -1, np.int32), np.zeros((0, SYMBOLS), np.int64)
        self.edit, self.goal = np.zeros((0, SYMBOLS, 4), np.int32), np.zeros((0, SYMBOLS, 4), np.int8)
        direct = [0 if q in FINAL else None for q in range(4)]
        self._state(self._closed(direct))
        self.rest = ["I" * next(i for i in range(3) if self._on(q, i) in FINAL) for q in range(4)]

    @staticmethod
    def _on(q: int, n: int) -> int:
        for _ in range(n):
            q = GO_ON[q]
        return q

    def _closed(self, direct: list) -> list[int]:
        """With turns inserted first: after two of them a state has come up before."""
        return [min(INSERT * i + direct[self._on(q, i)] for i in range(3) if direct[self._on(q, i)] is not None) for q in range(4)]

    def _state(self, vector: list[int]) -> tuple[int, int]:
        least = min(vector)
        key = tuple(v - least for v in vector)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
            if len(self.vectors) > len(self.next):
                more = max(16, len(self.next))
                self.next = np.concatenate([self.next, np.full((more, SYMBOLS), -1, np.int32)])
                self.weight = np.concatenate([self.weight, np.zeros((more, SYMBOLS), np.int64)])
                self.edit = np.concatenate([self.edit, np.zeros((more, SYMBOLS, 4), np.int32)])
                self.goal = np.concatenate([self.goal, np.zeros((more, SYMBOLS, 4), np.int8)])
        return self.ids[key], least

    @staticmethod
    def _edits(after: tuple[int, ...], symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost with what follows, state) of the edits of a row, in ASCII order."""
        out = [("D", DELETE + after[q], q)]
        if symbol != MUST_GO:
            stays = TRUNCATED * (symbol // 4)
            to = BY_ROLE[symbol % 4].get(q)
            if to is not None:
                out.append(("K", stays + after[to], to))
            out.append(("R", stays + REROLE + after[GO_ON[q]], GO_ON[q]))
        return out

    def add(self, state: int, symbol: int) -> None:
        after = self.vectors[state]
        edits = [self._edits(after, symbol, q) for q in range(4)]
        best = self._closed([min(cost for _, cost, _ in e) for e in edits])
        for q in range(4):
            at, letters = q, ""
            while True:
                tight = [(e[0], e[2]) for e in edits[at] if e[1] == best[at]]
                if INSERT + best[GO_ON[at]] == best[at]:
                    tight.append(("I", GO_ON[at]))
                letter, at = min(tight)
                letters += letter
                if letter != "I":
                    break
            if letters not in self.codes:
                self.codes[letters] = len(self.letters)
                self.letters.append(letters)
            self.edit[state, symbol, q], self.goal[state, symbol, q] = self.codes[letters], at
        to, weight = self._state(best)
        self.next[state, symbol], self.weight[state, symbol] = to, weight

    def solve(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs of conversations; codes of `letters` for each row; the state of the pattern that each conversation ends in.

        Row i of conversation c is at starts[c] + i.
        """
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # conversations with more rows than i
        state, cost, after = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64), np.zeros(len(symbols), np.int32)
        for i in range(longest):
            n = active[i]
            at = starts[:n] + sizes[:n] - 1 - i
            now, symbol = state[:n].copy(), symbols[at]
            for s, x in set(zip(*(v[self.next[now, symbol] < 0].tolist() for v in (now, symbol)))):
                self.add(s, x)
            after[at], state[:n] = now, self.next[now, symbol]
            cost[:n] += self.weight[now, symbol]
        cost += np.array(self.vectors)[state, 0]
        q, edits = np.zeros(len(sizes), np.int8), np.zeros(len(symbols), np.int32)
        for i in range(longest):
            n = active[i]
            at = starts[:n] + i
            edits[at], q[:n] = self.edit[after[at], symbols[at], q[:n]], self.goal[after[at], symbols[at], q[:n]]
        back = np.argsort(order, kind="stable")
        return cost[back], edits, q[back]


def _applied(letters: list[str], rest: str, roles: list[str], texts: list[str]) -> list[dict]:
    out, q = [], 0

    def named(text: str) -> None:
        nonlocal q
        q = GO_ON[q]
        out.append({"role": NAMES[q], "text": text})

    for x, role, text in zip(letters, roles, texts):
        for _ in range(len(x) - 1):
            named("")
        if x[-1] == "K":
            q = BY_ROLE["sua".find(role[0])][q]
            out.append({"role": role, "text": text})
        elif x[-1] == "R":
            named(text)
    for _ in rest:
        named("")
    return out


_LEGAL = frozenset(("su", "ua", "au"))


def _facts(turns: list, roles: list[str], texts: list[str], ends: list[str]) -> tuple[list[int], list[int]]:
    """(gaps, blank, duplicate, truncated, illegal) and the rows' symbols; ends: what the text's last visible character is."""
    seen, counts, symbols = set(), [0, 0, 0], []
    for role, text, end in zip(roles, texts, ends):
        fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        initial = "sua".find(role[0]) % 4 if role else 3
        symbols.append(MUST_GO if fault in (0, 1) else initial + 4 * (fault == 2))
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    initials = [r[:1] for r in roles]
    return [gaps, *counts, sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))], symbols


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine, held, ids, current = Automaton(), [], [], object()
    struct = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", *FAULTS, "illegal", "cost")] + [("audit", pa.string()), ("repaired", pa.list_(struct))])

    def done(convs: list, rows: list[tuple[list, list, list, list]]) -> pa.RecordBatch:
        facts, symbols = zip(*(_facts(*r) for r in rows))
        sizes = np.array([len(s) for s in symbols])
        starts = np.cumsum(sizes) - sizes
        costs, edits, states = machine.solve(np.array([x for s in symbols for x in s], np.int32), starts, sizes)
        letters = [machine.letters[e] for e in edits.tolist()]
        cut = [(letters[s : s + n], machine.rest[q] if n else "") for s, n, q in zip(starts.tolist(), sizes.tolist(), states.tolist())]
        audits = ["".join(x) + rest for x, rest in cut]
        repaired = [_applied(x, rest, r[1], r[2]) for (x, rest), r in zip(cut, rows)]
        columns = [convs, *map(list, zip(*facts)), costs.tolist(), audits, repaired]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for b in batches:
        for conv, turn, role, text, end, there in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "end", "there"))):
            if conv != current or not ids:
                ids.append(conv)
                held.append(([], [], [], []))
                current = conv
            if there:
                for x, v in zip(held[-1], (turn, role, text, end)):
                    x.append(v)
        if len(ids) > 1:
            yield done(ids[:-1], held[:-1])
            ids, held = ids[-1:], held[-1:]
    if ids:
        yield done(ids, held)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, there) with faults by crc32 of conv_id:turn; a dropped row stays without `there`."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    d = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).alias("_how")
    )
    how = F.col("_how")
    return d.select(
        "conv_id", "turn",
        F.when(how == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(how.isin(0, 1), F.lit("")).when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (how != 0).alias("there"),
        F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id and OUT for each conversation of the rows (conv_id, turn, role, text[, there]).

    The faults of a row are judged in the order of FAULTS. `illegal` counts neighbours whose roles may not follow each other.
    Rows that are not `there` only name their conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), there.alias("there"))
    d = d.withColumn("end", F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1))
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return d.mapInArrow(_repair, f"conv_id long, {OUT}")
