"""Best-fit packing: best-fit decreasing with a segment tree over the remaining capacities."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, splits_parts, vocabulary_path, word_tokenizer


class CapacityTree:
    """A segment tree over capacities 0..most; each leaf holds the open bins that have just this much room left."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins = [deque() for _ in range(most + 1)]

    def add(self, room: int, first: int, n: int, used: int) -> None:
        """n bins with the numbers first, first + 1, ..., all filled up to `used`."""
        if not n:
            return
        self.bins[room].append((first, n, used))
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def take(self, room: int) -> tuple[int, int, int]:
        group = self.bins[room].popleft()
        if not self.bins[room]:
            i = room + self.size
            self.any[i] = False
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = False
        return group

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` among open bins, in logarithmic time."""
        i = least + self.size
        if i >= 2 * self.size:
            return None
        while not self.any[i]:
            while i & 1:  # a right child: go up till there is something to the right
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """counts: how many items there are of each length 1..capacity. Returns runs (length, from rank, to rank, first bin,
    items per bin, offset of the first item): the item of that length and rank r lies in bin first + (r - from) // per
    at offset + (r - from) % per * length.

    The result is what best-fit decreasing gives item by item: items of one length that follow each other fill the
    tightest bin as long as they fit, so they are placed as runs. The work depends on the number of distinct lengths."""
    tree, runs, opened = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if (room := tree.tightest(length)) is None:
                room, per = capacity, capacity // length
                first, n, used = opened, -(-left // per), 0
                opened += n
            else:
                per = room // length
                first, n, used = tree.take(room)
            full = min(n, left // per)
            rest = left - full * per if full < n else 0
            placed = full * per + rest
            runs.append((length, rank, rank + placed, first, per, used))
            tree.add(room - per * length, first, full, used + per * length)
            if rest:
                tree.add(room - rest * length, first + full, 1, used + rest * length)
            tree.add(room, first + full + bool(rest), n - full - bool(rest), used)
            rank, left = rank + placed, left - placed
    return runs


def token_pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, kept_words: int = 120_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut into pieces
    of `capacity` tokens of which the last may be shorter. A null text is an empty one (one piece: the end). kept_words:
    how many words' ids a worker keeps at hand, twice at most; fewer take more time."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    kind, splits = docs.schema["doc_id"].dataType.simpleString(), splits_parts(path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        tokens, end, step = word_tokenizer(path, splits, kept_words), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = tokens.ids(text.as_py() or b"") + end
                for j, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    at.append(k)
                    piece.append(j)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        give_back()

    # shorter columns are all that crosses to Python
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, rows_per_bucket: int = 20_000, kept_words: int = 120_000) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens by best-fit decreasing over the whole corpus.

    Only the histogram of lengths (at most `capacity` rows) reaches the driver, where the runs of the packing are found.
    Pieces get a rank among those of their length in two steps (in a bucket, then the buckets' offsets), so no length,
    however common, meets in one task. Buckets go by the piece's place in the table that token_pieces is written to, so
    neither do equal ids or null ones. Repeated rows are packed as often as they come; null texts are empty; null ids
    stay null; no rows give no rows. Ties (equal lengths) are ranked by bucket, doc_id, piece and place."""
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, capacity, vocabulary, kept_words=kept_words).withColumn("uid", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = sorted(best_fit_decreasing(counts, capacity), key=lambda r: (r[0], r[1]))
    buckets = max(32, sum(counts.values()) // rows_per_bucket)
    bucket = F.pmod(F.xxhash64("uid"), F.lit(buckets))
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "uid")
    ranked = pieces.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(within) - 1)
    sizes = pieces.groupBy(bucket.alias("bucket"), "length").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    ranked = ranked.join(offsets, ["bucket", "length"]).withColumn("rank", F.col("rank") + F.col("skip"))

    # at most a few runs per length: their size doesn't grow with the corpus
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        span = max(1, int(t[:, 2].max())) + 1 if len(t) else 1
        keys = t[:, 0] * span + t[:, 1]  # lengths are at most the capacity, so this fits
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = t[np.searchsorted(keys, length * span + rank, side="right") - 1]
            k = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
