"""Benchmark decontamination: latent semantic candidates, then longest common subsequences and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, give_back, start_afresh

#: ASCII punctuation counts for nothing; words are lower-cased and split at ASCII white space.
DROPPED = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(None, DROPPED).split()


def place_masks(a: np.ndarray) -> dict[int, int]:
    """The places of each word number of a sequence as bits (negative numbers are equal to nothing)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        if w >= 0:
            masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_length(a: np.ndarray, b: np.ndarray, masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence of two sequences of word numbers, one machine-word operation per word of
    b on the bits of a; masks are place_masks(a)."""
    masks = place_masks(a) if masks is None else masks
    v = full = (1 << len(a)) - 1
    for w in b.tolist():
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Benchmark:
    """Items of one block. Passages are windows of the items; vectors are unit TF-IDF rows in the latent space."""

    ids: list
    words: list[np.ndarray]  # of each item, as numbers in `vocabulary`
    answers: list[np.ndarray]  # the last sentence of each item
    #: words x True for those that carry content: others are too common to tell an item by
    content: np.ndarray = field(init=False)
    vocabulary: dict[bytes, int]
    window: int
    passages: list[tuple[int, int, int]]  # item, from, to
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))  # the last is that of all other words
    basis: np.ndarray = field(default_factory=lambda: np.zeros(0))  # words x rank, scaled by idf
    vectors: np.ndarray = field(default_factory=lambda: np.zeros(0))  # passages x rank
    #: by word from first[word] to first[word + 1]: items that it tells and how often; by item: how many telling words a leak
    #: needs, the length of the stretches in which they count, and where its passages lie
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tells: np.ndarray = field(default_factory=lambda: np.zeros(0))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0))
    needs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))
    passage: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rare: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the index's (word, item) pairs: a rare word of the item
    checks: dict[int, tuple] = field(default_factory=dict)  # what check() worked out, by item

    def numbers(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))

    def windows(self, n: int) -> np.ndarray:
        """Where the windows of a text of n words begin; the last one ends with the text."""
        if n <= self.window:
            return np.zeros(1, np.int64)
        step = max(1, self.window // 4)
        return np.append(np.arange(0, n - self.window, step), n - self.window)

    def near(self, w: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(starts, lengths) of windows that have words of the benchmark, which hold at least `least` of the TF-IDF weight."""
        starts = self.windows(len(w))
        weight = self.idf[w] ** 2
        known = np.concatenate(([0.0], np.cumsum(np.where(w >= 0, weight, 0.0))))
        total = np.concatenate(([0.0], np.cumsum(weight)))
        ends = np.minimum(starts + self.window, len(w))
        inside = known[ends] - known[starts]
        keep = (inside > 0) & (inside >= least * (total[ends] - total[starts]))
        return starts[keep], (ends - starts)[keep]

    def telling(self, item: int) -> np.ndarray:
        """The words that tell an item: its content words, or all where there are under three."""
        words = self.words[item]
        return words[self.content[words]] if self.content[words].sum() >= 3 else words

    def answer(self, item: int) -> np.ndarray:
        """The content words of its answer; where that has too little of its own, the last content words stand for it."""
        words = self.answers[item]
        return words[self.content[words]] if self.content[words].sum() >= 2 else self.telling(item)[-4:]

    def check(self, item: int) -> tuple:
        """The telling words and the answer of an item, each with its place_masks."""
        if item not in self.checks:
            words, answer = self.telling(item), self.answer(item)
            self.checks[item] = words, place_masks(words), answer, place_masks(answer)
        return self.checks[item]

    def index(self, likely: float) -> None:
        """Which items each word tells, for stretches(): a leak has at least `likely` of an item's telling words. Of n telling
        words, of which it needs k, it has one of the rarest n - k + 1: these are the item's rare words."""
        told = [self.telling(i) for i in range(len(self.words))]
        lengths = np.array([len(t) for t in told])
        self.needs = np.maximum(1, np.ceil(likely * lengths - 1e-9)).astype(np.int64)
        self.reach = np.array([self.window + 2 * len(w) for w in self.words])
        each, self.times = np.unique(np.concatenate(told).astype(np.int64) * len(told) + np.repeat(np.arange(len(told)), lengths), return_counts=True)
        self.tells = each % len(told)
        self.first = np.searchsorted(each // len(told), np.arange(len(self.vocabulary) + 1))
        self.passage = np.searchsorted([p[0] for p in self.passages], np.arange(len(told) + 1))
        rare = [np.unique(t[np.lexsort((t, -self.idf[t]))][: len(t) - k + 1]) for t, k in zip(told, self.needs.tolist(), strict=True)]
        self.rare = np.isin(each, np.concatenate(rare).astype(np.int64) * len(told) + np.repeat(np.arange(len(told)), [len(r) for r in rare]))

    def pairs_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, pair): for each of the words the numbers of the (word, item) pairs of the index."""
        n = self.first[words + 1] - self.first[words]
        return np.repeat(np.arange(len(words)), n), np.repeat(self.first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def told_pairs(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, pair) for the items of which a text with these words, so many times each, has a rare word and as many
        telling words as a leak needs."""
        word, pair = self.pairs_of(words)
        there = np.zeros(len(self.needs), bool)
        there[self.tells[pair[self.rare[pair]]]] = True
        kept = there[self.tells[pair]]
        word, pair = word[kept], pair[kept]
        enough = np.bincount(self.tells[pair], np.minimum(self.times[pair], counts[word]), len(self.needs)) >= self.needs
        kept = enough[self.tells[pair]]
        return word[kept], pair[kept]

    def stretches(self, w: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, places, first) for some items at a time: their telling words in a text, sorted, and the numbers of those at
        which a stretch of the item's reach begins that holds as many as a leak needs, each at most as often as the item
        does. A common subsequence has no more words than that, and a stretch in which one is long enough needn't begin
        before its first word: no other can pass the check. Only places that have a rare word of the item within its reach
        are listed, since each such stretch holds one; a text's common words are so met near rare ones alone. Items are
        taken together as long as they have some `most` places."""
        at = np.flatnonzero(w >= 0)
        at = at[np.argsort(w[at], kind="stable")]
        words, start, counts = np.unique(w[at], return_index=True, return_counts=True)
        word, pair = self.told_pairs(words, counts)
        if not len(pair):
            return
        order = np.argsort(self.tells[pair], kind="stable")
        word, pair = word[order], pair[order]
        item = self.tells[pair]
        size = np.cumsum(counts[word])
        low = 0
        while low < len(pair):
            high = int(np.searchsorted(size, (size[low - 1] if low else 0) + most, side="right"))
            # whole items, one at least
            high = int(np.searchsorted(item, item[high])) if high < len(item) else len(item)
            if high <= low:
                high = int(np.searchsorted(item, item[low], side="right"))
            found = self.item_stretches(len(w), pair[low:high], start[word[low:high]], counts[word[low:high]], at)
            if len(found[2]):
                yield found
            low = high

    def item_stretches(self, n: int, pair: np.ndarray, start: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """stretches() for pairs whose places in the text of n words lie in `at` from start on."""
        span = n + 1

        def laid(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            c = count[which]
            place = at[np.repeat(start[which] - np.cumsum(c) + c, c) + np.arange(c.sum())]
            p = np.repeat(pair[which], c)
            return p, self.tells[p], place

        rare = self.rare[pair]
        _, items, places = laid(np.flatnonzero(rare))
        near = np.sort(items * span + places)
        pairs, items, places = laid(np.arange(len(pair)))
        key = items * span + places
        after = np.minimum(np.searchsorted(near, key), len(near) - 1)
        before = np.maximum(after - 1, 0)
        reach = self.reach[items]
        close = np.zeros(len(key), bool)
        for k in (after, before):
            close |= (near[k] // span == items) & (np.abs(near[k] - key) < reach)
        pair, item, at = pairs[close], items[close], places[close]
        order = np.lexsort((at, item))
        pair, item, at = pair[order], item[order], at[order]
        last = np.arange(len(item)) + self.needs[item] - 1
        first = np.flatnonzero(last < len(item))
        last = last[first]
        first = first[(item[last] == item[first]) & (at[last] - at[first] < self.reach[item[first]])]
        if not len(first):
            return item, at, first
        # where a word stood as often before as the item has it: in a stretch from there on it is one too many
        by_pair = np.argsort(pair, kind="stable")
        same = pair[by_pair]
        back = np.arange(len(same)) - self.times[same]
        before = np.full(len(same), -1)
        again = (back >= 0) & (same[back] == same)
        before[by_pair[again]] = at[by_pair[back[again]]]
        ends = np.searchsorted(item * span + at, item[first] * span + np.minimum(at[first] + self.reach[item[first]], span - 1))
        sizes = ends - first
        begin = np.cumsum(sizes) - sizes
        inside = np.repeat(first - begin, sizes) + np.arange(sizes.sum())
        counts = np.add.reduceat(before[inside] < np.repeat(at[first], sizes), begin, dtype=np.int64)
        return item, at, first[counts >= self.needs[item[first]]]


def load_block(rows: list, window: int) -> Benchmark:
    vocabulary: dict[bytes, int] = {}
    ids, words, answers, passages = [], [], [], []
    for item_id, text in rows:
        raw = (text or "").encode("utf-8", "replace")
        w = [vocabulary.setdefault(x, len(vocabulary)) for x in words_of(raw)]
        if not w:
            continue
        sentences = [s for s in raw.replace(b"\n", b" ").split(b". ") if words_of(s)]
        ids.append(item_id)
        words.append(np.array(w))
        answers.append(np.array([vocabulary[x] for x in words_of(sentences[-1])] if sentences else w))
        for a in range(0, max(1, len(w) - window // 2), max(1, window // 2)):
            passages.append((len(ids) - 1, a, min(len(w), a + window)))
    return Benchmark(ids, words, answers, vocabulary, window, passages)


#: Windows that are sketched together: each takes `window` x `rank` doubles a few times over.
SKETCHED = 400


def sketch_rows(b: Benchmark, rows: list[np.ndarray], omega: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A omega) to out; A has a TF-IDF row of unit length for each window of word numbers in rows."""
    if not rows:
        return
    x, starts = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
    weight = b.idf[x]
    norm2 = np.add.reduceat(weight**2, starts)
    weight = np.where(x >= 0, weight, 0.0)[:, None]
    projected = np.add.reduceat(weight * omega[x], starts) / norm2[:, None]
    order = np.argsort(x, kind="stable")
    back = (weight * np.repeat(projected, [len(r) for r in rows], axis=0))[order]
    words, first = np.unique(x[order], return_index=True)
    sums = np.add.reduceat(back, first)
    out[words[words >= 0]] += sums[words >= 0]


def fit_block(docs: DataFrame, block: Benchmark, rank: int, share: float, likely: float, seed: int = 11) -> DataFrame:
    """Fits the block and returns (doc_id, words) of the documents that have a stretch() of some item; no other can pass
    the subsequence check.

    IDF counts all documents. Then one round of a randomised SVD: A'(A omega) is summed over the passages of the
    benchmark and the windows of all documents that lie near it (which fits the basis and rules out no candidate), and an
    orthonormal basis of its range spans the latent space (a rotation to the singular vectors would change no cosine). What reaches the
    driver is words x rank sums, of the block's words only. Texts are read once; their word numbers are kept."""
    spark, size, kind = docs.sparkSession, len(block.vocabulary), docs.schema["doc_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(block)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        b = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.numbers(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["doc_id", "words"])

    numbered = cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(number, f"doc_id {kind}, words binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                w = np.unique(np.frombuffer(t.as_py(), np.int32))
                df[w[w >= 0]] += 1
            df[size] += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["word", "n"])

    df = np.zeros(size + 1)
    for r in numbered.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r.word] = r.n
    block.idf = np.log((df[size] + 1) / (df + 1)) + 0.05
    block.content = block.idf[:size] > 1.0
    block.index(likely)
    # of other words only this is known: they are as rare as words of the benchmark are on the mean
    block.idf[size] = block.idf[:size].mean()
    rank = min(rank, size)
    omega = np.random.default_rng(seed).standard_normal((size, rank))
    fitted = spark.sparkContext.broadcast((block, omega))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, o = fitted.value
        y, names = np.zeros_like(o), ["doc_id", "words", "word", "y"]
        for batch in batches:
            keep, rows = [], []
            for k, t in enumerate(batch.column(1)):
                w = np.frombuffer(t.as_py(), np.int32)
                if any(b.stretches(w)):
                    keep.append(k)
                starts, sizes = b.near(w, share)
                if len(starts):
                    rows += [w[a : a + n] for a, n in zip(starts, sizes, strict=True)]
                    if len(rows) > SKETCHED:
                        sketch_rows(b, rows, o, y)
                        rows = []
            sketch_rows(b, rows, o, y)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.nulls(len(keep), pa.int32()), pa.nulls(len(keep), pa.list_(pa.float32()))], names=names)
            last = batch
        at = np.flatnonzero(y.any(1))
        if len(at):
            none = [pa.nulls(len(at), f.type) for f in last.schema]
            yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(list(y[at].astype(np.float32)), pa.list_(pa.float32()))], names=names)
        give_back()

    found = cut(numbered.mapInArrow(sketch, f"doc_id {kind}, words binary, word int, y array<float>"))
    add = F.array(*[F.sum(F.col("y")[i]) for i in range(rank)]).alias("y")
    y = np.zeros_like(omega)
    sketch_rows(block, [block.words[i][a:z] for i, a, z in block.passages], omega, y)
    for r in found.where("word is not null").groupBy("word").agg(add).toLocalIterator():
        y[r.word] += r.y
    basis, _ = np.linalg.qr(y)
    # the last row, of words that no item has, is zero
    block.basis = np.concatenate((block.idf[:size, None] * basis, np.zeros((1, rank)))).astype(np.float32)
    vectors = np.array([block.basis[block.words[i][a:z]].sum(0) for i, a, z in block.passages], np.float32)
    block.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    held.destroy()
    fitted.destroy()
    return found.where("words is not null").select("doc_id", "words")


def leaks(b: Benchmark, w: np.ndarray, cosine: float, sure: float) -> list[tuple[int, float, float, bool]]:
    """(item, cosine, share, whether the answer is there) of the items that a text leaks.

    A candidate is a stretch of an item's reach that meets a window whose latent cosine with a passage of the item is at
    least `cosine`. It is a leak if `sure` of the item's telling words are a common subsequence with it, or as many as a
    leak needs at least and three quarters of the answer. The share is that of the stretch with most, on ties with the
    answer."""
    found: dict[int, tuple[float, float, bool]] = {}
    for item_of, places, first in b.stretches(w):
        check_stretches(b, w, item_of, places, first, cosine, sure, found)
    return [(item, *found[item]) for item in sorted(found)]


def check_stretches(b: Benchmark, w: np.ndarray, item_of: np.ndarray, places: np.ndarray, first: np.ndarray, cosine: float, sure: float, found: dict[int, tuple[float, float, bool]]) -> None:
    """leaks() for the stretches of some items; adds to found."""
    grid, items, starts = b.windows(len(w)), item_of[first], places[first]
    # stretches of an item that overlap form a region
    edge = np.flatnonzero((np.diff(items) != 0) | (np.diff(starts) >= b.reach[items[1:]])) + 1
    for low, high in zip(np.append(0, edge).tolist(), np.append(edge, len(items)).tolist(), strict=True):
        item, a = int(items[low]), int(starts[low])
        words, masks, answer, answer_masks = b.check(item)
        need, reach = int(b.needs[item]), int(b.reach[item])
        z = min(len(w), int(starts[high - 1]) + reach)
        at = places[first[low] : np.searchsorted(item_of, item, side="right")]
        at = at[: np.searchsorted(at, z)]
        told = w[at]
        if common_length(words, told, masks) < need:
            continue
        # windows that meet the region, their vectors from running sums
        near = grid[np.searchsorted(grid, a - b.window, side="right") : np.searchsorted(grid, z)]
        left, right = int(near[0]), min(len(w), int(near[-1]) + b.window)
        sums = np.concatenate((np.zeros((1, b.basis.shape[1])), np.cumsum(b.basis[w[left:right]], axis=0, dtype=np.float64)))
        ends = np.minimum(near + b.window, len(w))
        vectors = sums[ends - left] - sums[near - left]
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        cos = (vectors @ b.vectors[b.passage[item] : b.passage[item + 1]].T).max(1)
        near, ends, cos = near[cos >= cosine], ends[cos >= cosine], cos[cos >= cosine]
        for start in starts[low:high].tolist() if len(near) else ():
            part = told[np.searchsorted(at, start) : np.searchsorted(at, start + reach)]
            if (n := common_length(words, part, masks)) < need:
                continue
            meets = cos[(near < start + reach) & (ends > start)]
            has_answer = common_length(answer, part, answer_masks) >= 0.75 * len(answer)
            if len(meets) and (has_answer or n >= sure * len(words)):
                best, *most = found.get(item, (0.0, 0.0, False))
                found[item] = max(float(meets.max()), best), *max((n / len(words), has_answer), tuple(most))


def fitted_blocks(docs: DataFrame, benchmark: DataFrame, window: int, rank: int, share: float, block_bytes: int) -> Iterator[tuple[Benchmark, DataFrame]]:
    """Blocks of items of about `block_bytes` of text each, each with the documents that may leak some of it. That bounds what
    is broadcast: a block has at most one different word for each seven bytes or so, and for each word `rank` doubles."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).orderBy("item_id", "text").toLocalIterator()
        if (block := load_block(list(rows), window)).ids:
            near = fit_block(docs, block, rank, share, LIKELY)
            yield block, near


#: The basis is fitted on windows of which the benchmark's words hold SHARE of the TF-IDF weight; any window can be a
#: candidate. COSINE, SURE and LIKELY: see leaks(); LIKELY is the share of the telling words that a leak needs at least.
SHARE, COSINE, SURE, LIKELY = 0.4, 0.5, 0.7, 0.5


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 24, rank: int = 64, block_bytes: int = 4 << 20) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, cosine, overlap, has_answer): a row for each
    leak in each row of docs, from whole texts.

    Null and empty texts leak nothing; null ids of documents stay null; items without an id or words are left out;
    repeated items are items of their own, with the same item_id."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, overlap double, has_answer boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    for block, near in fitted_blocks(docs, benchmark, window, rank, SHARE, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = held.value
            for batch in batches:
                rows = [(k, *x) for k, t in enumerate(batch.column(1)) for x in leaks(b, np.frombuffer(t.as_py(), np.int32), COSINE, SURE)]
                at, item, cos, part, answer = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array([b.ids[i] for i in item], item_type), pa.array(cos, pa.float64()), pa.array(part, pa.float64()), pa.array(answer, pa.bool_())],
                    names=["doc_id", "item_id", "cosine", "overlap", "has_answer"],
                )

        out = out.unionByName(near.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 24, rank: int = 64, block_bytes: int = 4 << 20) -> DataFrame:
    """docs without the documents that leak an item; all columns stay as they are. Verdicts are made next to the rows."""
    left = docs
    for block, _ in fitted_blocks(docs, benchmark, window, rank, SHARE, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = held.value
            for batch in batches:
                texts = ((t.as_py() or "").encode("utf-8", "replace") for t in batch.column("text"))
                yield batch.filter(pa.array([not leaks(b, b.numbers(t), COSINE, SURE) for t in texts], pa.bool_()))
            give_back()

        left = left.mapInArrow(run, docs.schema)
    return left
