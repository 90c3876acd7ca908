"""Periodic runs of words by recompression.

A run is a stretch of consecutive words with smallest period q, at least
``max(12, 2 q)`` words long, that no neighbouring word extends.

The words of a batch of texts are compressed into one run-length grammar,
level by level, in turn by blocks (equal neighbours become one symbol that
holds their number) and by pairs (a coin per symbol says which may come left
and which right; a left one before a right one becomes a symbol of both).
What is equal gets equal names, so how far two places of a text agree is read
off the grammar: climb while the symbols above agree, step over equal ones,
then descend to the first that differ.  All questions of a batch advance
together, as numpy arrays.

Where to ask: a run of period p holds ``p`` or more places that agree with
the one p further on, so one of them is a multiple of p.  The candidates are
these multiples for every p (a harmonic sum, near-linear in the text), where
the two words are the same.  Agreement to both sides gives the exact run.  A
run also shows up under multiples of its period; the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchwise.llm.common import bounded_batches, nullable, quoted, text_of

LEAST_WORDS = 12
#: Words that are compressed together, and questions that advance together.
BATCH_WORDS = 1 << 18
BATCH_QUESTIONS = 1 << 17
#: Places of the grid that are made once per worker and serve all texts.
GRID_WORDS = 1 << 14

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _coins(symbols: np.ndarray, turn: int) -> np.ndarray:
    """A bit for each symbol, another one in every turn."""
    x = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1)


class Grammar:
    """The run-length grammar of texts, given as arrays of word numbers.

    Nodes of all levels lie in one array; those of level 0 are the words, each
    text followed by a mark of its own (a negative symbol, which takes part in
    no block or pair), and one mark in front.  Index 0 of the second axis of
    the tables is the way to the right, 1 the way to the left:

    - ``up``: the node above, if this one is its outermost on the side where
      the way begins, else -1;
    - ``down``: the outermost node below on that side, -1 at level 0;
    - ``same``: how many nodes from here on along the way have this symbol.
    """

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes
        total = int(sizes.sum()) + len(texts) + 1
        symbols = np.empty(total, np.int64)
        marks = np.concatenate([[0], self.starts + sizes]).astype(np.int64)
        words = np.ones(total, bool)
        words[marks] = False
        symbols[words] = np.concatenate(texts) if len(texts) else 0
        symbols[marks] = -1 - np.arange(len(marks))
        self.words, self.names = symbols, int(symbols.max(initial=0)) + 1
        self.symbols, self.up, self.down, self.same = [], [], [], []
        self.offset, turn = 0, 0
        self._level(symbols, np.full((total, 2), -1, np.int64))
        while True:
            symbols, place = self._rest(symbols)
            if len(symbols) <= 1:
                break
            # Blocks: equal neighbours.
            first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
            size = np.diff(np.append(first, len(symbols)))
            if len(first) < len(symbols):
                named, many = symbols[first], size > 1
                named[many] = self._named(named[many], size[many])
                symbols, place = self._above(named, place, first, size)
                symbols, left = self._rest(symbols)
                place = left
                if len(symbols) <= 1:
                    break
            # Pairs: a left symbol before a right one.
            coin = _coins(symbols, turn)
            turn += 1
            inner = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
            ways = [inner & (coin[:-1] == side) & (coin[1:] != side) for side in (0, 1)]
            pair = max(ways, key=np.count_nonzero)
            at = np.flatnonzero(pair)
            if not len(at):
                continue
            begins = np.ones(len(symbols), bool)
            begins[at + 1] = False
            first = np.flatnonzero(begins)
            size = np.diff(np.append(first, len(symbols)))
            named, two = symbols[first], size > 1
            named[two] = self._named(symbols[at], symbols[at + 1])
            symbols, place = self._above(named, place, first, size)
        self.symbols, self.up = np.concatenate(self.symbols), np.concatenate(self.up)
        self.down, self.same = np.concatenate(self.down), np.concatenate(self.same)

    def _named(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """New names, equal for equal pairs of numbers."""
        _, names = np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)
        names = names + self.names
        self.names = int(names.max(initial=self.names - 1)) + 1
        return names

    def _level(self, symbols: np.ndarray, down: np.ndarray) -> None:
        edges = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        size = np.diff(np.append(edges, len(symbols)))
        inside = np.arange(len(symbols)) - np.repeat(edges, size)
        self.symbols.append(symbols)
        self.up.append(np.full((len(symbols), 2), -1, np.int64))
        self.down.append(down)
        self.same.append(np.stack([np.repeat(size, size) - inside, inside + 1], axis=1))
        self.base, self.offset = self.offset, self.offset + len(symbols)

    def _rest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the texts that are one symbol, or none, by now, with the
        places of the others in their level."""
        marks = np.flatnonzero(symbols < 0)
        done = np.append(False, np.diff(marks) <= 2)
        keep = np.ones(len(symbols), bool)
        keep[marks[done]] = False
        single = np.append(False, np.diff(marks) == 2)
        keep[marks[single] - 1] = False
        place = np.flatnonzero(keep)
        return symbols[place], place

    def _above(self, named, place, first, size) -> tuple[np.ndarray, np.ndarray]:
        """A new level: its symbols stand for ``size`` nodes from ``first``."""
        low, high = place[first], place[first + size - 1]
        new = self.offset + np.arange(len(named))
        self.up[-1][low, 0] = new
        self.up[-1][high, 1] = new
        base = self.base
        self._level(named, np.stack([low + base, high + base], axis=1))
        return named, np.arange(len(named))

    def agreement(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many words agree from places ``a`` and ``b`` (``a < b``, of one
        text, places of level 0) on: to the right (way 0), or to the left (1)."""
        symbols, up, down, same = self.symbols, self.up[:, way], self.down[:, way], self.same[:, way]
        sign, begin = 1 - 2 * way, (b if way else a)
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        a, b, falling = a.copy(), b.copy(), np.zeros(len(a), bool)
        while len(live):
            equal = symbols[a] == symbols[b]
            above_a, above_b = up[a], up[b]
            climb = equal & ~falling & (above_a >= 0) & (above_b >= 0) & (symbols[above_a] == symbols[above_b])
            step = np.where(equal & ~climb, np.minimum(same[a], same[b]) * sign, 0)
            under_a, under_b = down[a], down[b]
            done = ~equal & (under_a < 0)
            out[live[done]] = ((b if way else a)[done] - begin[live[done]]) * sign
            falling = falling | ~equal
            a = np.where(climb, above_a, np.where(equal, a + step, under_a))
            b = np.where(climb, above_b, np.where(equal, b + step, under_b))
            if done.any():
                stay = ~done
                live, a, b, falling = live[stay], a[stay], b[stay], falling[stay]
        return out


def _grid(low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): every place ``j`` in [low, high) that is a multiple of
    a period up to ``most``, but not zero; sorted by place."""
    p = np.arange(1, min(most, high - 1) + 1)
    count = (high - 1) // p - (max(low, 1) - 1) // p
    period = np.repeat(p, count)
    nth = np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)
    place = period * ((max(low, 1) - 1) // period + 1 + nth)
    order = np.argsort(place, kind="stable")
    return place[order], period[order]


@cache
def _first_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of the first places, and how much of it lies before each place."""
    place, period = _grid(1, GRID_WORDS, GRID_WORDS)
    return place, period, np.searchsorted(place, np.arange(GRID_WORDS + 1))


def _candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) on the grid, where the word at ``place`` is also
    ``period`` words before it."""
    n, found = len(words), []
    if n < LEAST_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    for low in range(0, n, GRID_WORDS):
        high = min(n, low + GRID_WORDS)
        if low:
            place, period = _grid(low, high, n // 2)
        else:
            place, period, before = _first_grid()
            place, period = place[:before[high]], period[:before[high]]
        hit = np.flatnonzero(words[place] == words[place - period])
        hit = hit[2 * period[hit] <= n]
        found.append((place[hit], period[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(texts: list[np.ndarray]) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start, period."""
    grids = [_candidates(t) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(g[0]) for g in grids])
    if not len(text):
        return np.empty((0, 4), np.int64)
    place, period = (np.concatenate([g[k] for g in grids]) for k in (0, 1))
    grammar, made = Grammar(texts), []
    for k in range(0, len(text), BATCH_QUESTIONS):
        t, p = text[k:k + BATCH_QUESTIONS], period[k:k + BATCH_QUESTIONS]
        b = grammar.starts[t] + place[k:k + BATCH_QUESTIONS]
        right = grammar.agreement(b - p, b, 0)
        left = grammar.agreement(b - p - 1, b - 1, 1)
        ok = (left + right >= p) & (left + right + p >= LEAST_WORDS)
        start = b - p - left - grammar.starts[t]
        made.append(np.stack([t, start, left + right + p, p], axis=1)[ok])
    rows = np.concatenate(made)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))[:len(rows)]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _parts(texts: list[str]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in parts of about ``BATCH_WORDS`` words."""
    part, size = [], 0
    for text in texts:
        part.append(text.encode("utf-8", "surrogatepass").split())
        size += len(part[-1])
        if size >= BATCH_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text -> doc, runs, collapsed."""
    for batch in batches:
        at = 0
        for part in _parts(batch.column("text").to_pylist()):
            numbers = _Numbers()
            texts = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in part]
            rows = runs_of(texts)
            sizes = np.array([len(t) for t in texts])
            begins = np.cumsum(sizes) - sizes
            covered = np.zeros(int(sizes.sum()) + 1, np.int64)
            if len(rows):
                first = begins[rows[:, 0]] + rows[:, 1]
                np.add.at(covered, first + rows[:, 3], 1)
                np.add.at(covered, first + rows[:, 2], -1)
            gone = np.cumsum(covered) > 0
            n_runs = np.bincount(rows[:, 0], minlength=len(part))
            collapsed = []
            for words, k, begin in zip(part, n_runs.tolist(), begins.tolist(), strict=True):
                if k:
                    words = [words[i] for i in np.flatnonzero(~gone[begin:begin + len(words)]).tolist()]
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32())
            runs = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(at, len(part)), pa.ListArray.from_arrays(offsets, runs), pa.array(collapsed, pa.string())],
                ["doc", "runs", "collapsed"])
            at += len(part)


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, repeated rows too: its columns except the
    text, ``runs`` (start, length, period in words, by start, then period) and
    ``collapsed``: the words, joined by one space, without those that lie in
    some run after that run's first period.

    A null or empty text has no runs and collapses to the empty text.  No text
    is cut; a long one takes a task's memory in proportion to its length.
    Own columns named ``runs`` or ``collapsed`` give way.  An empty table
    gives none.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("text", "runs", "collapsed")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *quoted(own)).alias("doc"), text_of().alias("text"))
    schema = T.StructType([T.StructField("doc", nullable(rows.schema["doc"].dataType)), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    made = rows.mapInArrow(_found, schema)
    return made.select(*[F.col("doc").getField(c).alias(c) for c in own], "runs", "collapsed")
