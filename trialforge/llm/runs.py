"""Periodic runs of words by recompression: a run-length grammar of block and pair steps answers how far candidates reach."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Words of a batch that share one grammar (a longer text has one of its own), and grid points that are met at a time.
BATCH_WORDS, GRID_POINTS = 200_000, 2_000_000


@dataclass
class Step:
    """From one level of the grammar to the next: up[k] is the parent of symbol k, first[j] the first child of parent j
    (one entry more at the end); blocks: parents are runs of one symbol, else pairs or single symbols."""

    blocks: bool
    up: np.ndarray
    first: np.ndarray


@dataclass
class Grammar:
    symbols: list[np.ndarray] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)

    @classmethod
    def of(cls, text: np.ndarray) -> Grammar:
        """text: symbols from 0; its first and last symbol must occur nowhere else. Maximal runs of a symbol become one
        symbol, then disjoint pairs of a left and a right symbol do, in turns, until no symbol occurs twice. Which symbols
        are left ones is drawn by a hash for each level; equal neighbours are in runs, so pairs can't overlap. Symbols
        are named exactly, by (symbol, run) and (left, right), so equal names stand for equal words."""
        g, s = cls(), text.astype(np.int64)
        g.symbols.append(s.astype(np.int32))
        distinct, seed = len(np.unique(s)), 0
        while distinct < len(s):
            for blocks in (True, False):
                if blocks:
                    starts = np.concatenate(([True], s[1:] != s[:-1]))
                else:
                    seed += 1
                    right = ((s.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(1) == 1
                    pair = ~right[:-1] & right[1:]
                    other = right[:-1] & ~right[1:]
                    pair = other if other.sum() > pair.sum() else pair
                    starts = np.concatenate(([True], ~pair))
                if starts.all():
                    continue
                first = np.append(np.flatnonzero(starts), len(s))
                size, head = np.diff(first), s[first[:-1]]
                # of a pair the second symbol, of a run its length; 0 stands for a symbol on its own
                rest = size if blocks else np.where(size > 1, s[np.minimum(first[:-1] + 1, len(s) - 1)] + 1, 0)
                named, names = pd.factorize(head * (int(rest.max()) + 1) + rest)
                g.steps.append(Step(blocks, (np.cumsum(starts) - 1).astype(np.int32), first.astype(np.int32)))
                s, distinct = named.astype(np.int64), len(names)
                g.symbols.append(s.astype(np.int32))
        return g

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Lengths of the longest common extensions from the words i and j (i <> j) on, to the right, or to the left.

        All queries climb the levels together while both ends stand at an edge of their parents, matching at most a run or
        one symbol of a pair on each level, until their symbols differ; then they step down again. A query costs a few
        steps for each level that it reaches, and those are as many as the logarithm of its answer."""
        way = -1 if back else 1
        a, b, level = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        climbing = np.arange(len(i))
        for k, step in enumerate([*self.steps, None]):
            s = self.symbols[k]
            climbing = climbing[s[a[climbing]] == s[b[climbing]]]
            if step is None or not len(climbing):
                break
            x, y = a[climbing], b[climbing]
            px, py = step.up[x], step.up[y]
            left_x, left_y = (x - step.first[px] + 1, y - step.first[py] + 1) if back else (step.first[px + 1] - x, step.first[py + 1] - y)
            whole = (step.first[px + 1] - step.first[px] == left_x) & (step.first[py + 1] - step.first[py] == left_y)
            move = np.where(whole, 0, np.minimum(left_x, left_y) if step.blocks else 1)
            x, y = x + way * move, y + way * move
            a[climbing], b[climbing] = x, y
            # where runs of different length were left, or the next symbols differ, this level ends the climb
            up = s[x] == s[y]
            climbing = climbing[up]
            x, y = x[up], y[up]
            a[climbing], b[climbing], level[climbing] = step.up[x], step.up[y], k + 1
        for k in range(int(level.max(initial=0)), 0, -1):
            step, s = self.steps[k - 1], self.symbols[k - 1]
            at = np.flatnonzero(level == k)
            x, y = a[at], b[at]
            size = np.minimum(step.first[x + 1] - step.first[x], step.first[y + 1] - step.first[y]) if step.blocks else 1
            x, y = (step.first[x + 1] - 1, step.first[y + 1] - 1) if back else (step.first[x], step.first[y])
            move = np.where(s[x] == s[y], size, 0)
            a[at], b[at], level[at] = x + way * move, y + way * move, k - 1
        return np.abs(a - i)


def grid(w: np.ndarray, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, period) of a text for each period p: multiples of p at which `repeats` points in a row hold one word. A run of
    p that is `repeats` times as long holds such a point. All points of a period come together, some GRID_POINTS at a time.

    Words a step apart are strided slices: over the points of a period where that is small, over the periods of a point's
    number where that is."""
    n, most = len(w), len(w) // repeats
    small = min(most, int(n**0.5))

    def in_row(same: list[np.ndarray], h: int) -> np.ndarray:
        out = same[0][:h] & same[-1][:h]
        for x in same[1:-1]:
            out &= x[:h]
        return out.nonzero()[0]

    for p in range(1, small + 1):
        x = w[::p]
        same = x[1:] == x[:-1]
        k = in_row([same[d:] for d in range(repeats - 1)], len(same) - (repeats - 2))
        if len(k):
            yield k * p, np.full(len(k), p)
    low = small + 1
    while low <= most:
        high = min(most, low + max(small, GRID_POINTS * low // n))
        points, periods, same = [], [], []
        for k in range((n - 1) // low):
            h = min(high, (n - 1) // (k + 1)) - low + 1
            x = w[k * low :: k][:h] if k else w[0]
            same = [*same[-(repeats - 2) :], x == w[(k + 1) * low :: k + 1][:h]]
            if len(same) == repeats - 1:
                p = in_row(same, h) + low
                if len(p):
                    points.append((k - (repeats - 2)) * p)
                    periods.append(p)
        if points:
            i, p = np.concatenate(points), np.concatenate(periods)
            order = np.lexsort((i, p))
            yield i[order], p[order]
        low = high + 1


def runs_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, repeats: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs, by start, then period, of the texts at starts, with sizes, inside words
    (symbols from 0; between and around texts lie symbols that occur once)."""
    found, grammar, waiting, held = [], None, [], 0
    small = words.astype(np.int32)
    points = ((i + a, p) for a, n in zip(starts, sizes) if n >= least for i, p in grid(small[a : a + n], repeats))
    for got in chain(points, (None,)):
        if got is not None:
            waiting.append(got)
            held += len(got[0])
        if not waiting or (got is not None and held < GRID_POINTS):
            continue
        i, p = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting, held, rounds = [], 0, 0
        grammar = grammar or Grammar.of(words)
        while len(i):
            # a point on from one that a run covers is in that run: so first points only, but all after a few rounds
            first = np.concatenate(([True], (p[1:] != p[:-1]) | (i[1:] != i[:-1] + p[1:]))) if rounds < 3 else np.ones(len(i), bool)
            x, q = i[first], p[first]
            end = x + q + grammar.common(x, x + q)
            begin = x - grammar.common(x - 1, x + q - 1, back=True)
            found.append(np.stack([begin, end, q], 1))
            covered = end[np.cumsum(first) - 1]
            left = i + p >= covered
            left[first] = False
            i, p, rounds = i[left], p[left], rounds + 1
    if not found:
        return np.zeros((0, 3), np.int64)
    r = np.concatenate(found)
    r = r[r[:, 1] - r[:, 0] >= np.maximum(least, repeats * r[:, 2])]
    r = r[np.lexsort((r[:, 2], r[:, 1], r[:, 0]))]
    # of one stretch the smallest period; its multiples find it, too
    r = r[np.concatenate(([True], (r[1:, :2] != r[:-1, :2]).any(1)))] if len(r) else r
    return r[np.lexsort((r[:, 2], r[:, 0]))]


def symbols_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, sizes): the words of all texts as numbers, texts parted and enclosed by numbers of their own."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    ids = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    n = len(ids.dictionary)
    out = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    parted = np.append(starts - 1, len(out) - 1)
    inside = np.ones(len(out), bool)
    inside[parted] = False
    out[inside], out[parted] = ids.indices.to_numpy(zero_copy_only=False), n + np.arange(len(parted))
    return out, starts, sizes


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by a space; runs as (start, end, period) from 0."""
    if len(runs):
        cover = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(words) + 1) - np.bincount(runs[:, 1], minlength=len(words) + 1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(cover)[: len(words)] == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, repeats: int = 4, least: int = 6, prepare: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, runs, collapsed), a row for each row: runs has the structs (start, length,
    period), in words from 0, by start, then period, of all stretches of at least `least` words and `repeats` smallest
    periods that no neighbour extends; collapsed is the text without the words that repeat in a run.

    Words are parted by ASCII white space. prepare(id as text, words) may change a document's words first. A null or empty
    text has no words, no runs and an empty collapsed text. Equal rows get equal results. Extra columns play no part."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def made(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        words, starts, sizes = symbols_of(texts)
        found = runs_of(words, starts, sizes, repeats, least)
        edges = np.searchsorted(found[:, 0], np.append(starts, len(words)))
        found[:, :2] -= np.repeat(starts, np.diff(edges))[:, None]
        collapsed = [collapse(t, found[a:b]) for t, a, b in zip(texts, edges, edges[1:])]
        rows = pa.StructArray.from_arrays([pa.array(x) for x in (found[:, 0], found[:, 1] - found[:, 0], found[:, 2])], fields=list(shape))
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), rows), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column("name").to_pylist(), []
            begin = held = 0
            for k, text in enumerate(batch.column("text")):
                words = (text.as_buffer() or b"") and text.as_buffer().to_pybytes().split()
                words = prepare(names[k], words) if prepare else words
                if held and held + len(words) > BATCH_WORDS:
                    yield made(batch.column("doc_id").slice(begin, k - begin), texts)
                    begin, held, texts = k, 0, []
                texts.append(words)
                held += len(words)
            if texts:
                yield made(batch.column("doc_id").slice(begin), texts)
        give_back()

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeated_tail(name: str | None, words: list[bytes]) -> list[bytes]:
    """For each tenth id by its checksum, the words from some place on repeat what follows that place: periods to be found."""
    h, n = zlib.crc32((name or "").encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic_runs' rows: the
    longest run (ties: the smallest start, then period; null where there is none) and checksums."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length = -F.col("best.shorter")
    milli = F.floor(F.expr("(1000 * -best.shorter) div best.period")).cast("long")
    return d.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
