"""Toxicity by compression distance: how much shorter do a text's windows get with a zstandard dictionary of toxic text?"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_crc

#: Bytes of a window, and how far back a window's end may move to a space. Literals of a window stay under the 64 bytes
#: from which zstandard packs them, so that lengths differ by what the dictionaries match and nothing else.
WINDOW, SNAP = 40, 14
#: Both dictionaries end with these bytes and each window begins with them: a block that saves few bytes is stored as it
#: is, which would hide short matches; with the preamble every block saves more than that. UTF-8 text holds no such run.
PREAMBLE = bytes(range(128, 160))
#: Windows end with these: no match begins in the last eight bytes of a block, so these must not be the window's own.
TAIL = bytes(range(160, 168))
GRAM, BITS, BESIDE = 6, 20, 4
#: Gains in bytes over which windows are counted.
STEPS = (2, 3, 4, 6)
WHITE = re.compile(rb"[\x20\x09-\x0D]+")


def plain(text: str | None) -> bytes:
    """The lower-cased text, its words parted, begun and ended by one space."""
    return b" " + WHITE.sub(b" ", (text or "").lower().encode("utf-8", "replace")).strip(b" ") + b" "


def windows(b: bytes) -> list[tuple[int, int]]:
    """(start, end) of consecutive windows that cover b: each ends at a space where one is near; neighbours share it."""
    spaces = np.flatnonzero(np.frombuffer(b, np.uint8) == 32)
    k = np.arange(WINDOW, len(b), WINDOW)
    near = spaces[np.maximum(np.searchsorted(spaces, k, side="right") - 1, 0)]
    ends = [*np.where((near <= k) & (k - near < SNAP), near, k).tolist(), len(b)]
    return [(a, min(e + 1, len(b))) for a, e in zip([0, *ends], ends)]


def rolled(a: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the `width` bytes from each place on."""
    h = np.zeros(max(0, len(a) - width + 1), np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - width + 1 + i] + np.uint64(1)
    return h * np.uint64(0xD6E8FEB86659FD93)


def grams(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, start, surroundings) of the n-grams of b that no space parts; surroundings is a hash of BESIDE bytes on either
    side, from 0 to 63."""
    a = np.frombuffer(b, np.uint8)
    if len(a) < GRAM:
        return (np.zeros(0, np.int64),) * 3
    spaces = np.concatenate(([0], np.cumsum(a == 32)))
    n = len(a) - GRAM + 1
    at = np.flatnonzero(spaces[GRAM - 1 : GRAM - 1 + n] == spaces[1 : 1 + n])
    bucket = (rolled(a, GRAM)[at] >> np.uint64(64 - BITS)).astype(np.int64)
    around = rolled(np.pad(a, BESIDE), GRAM + 2 * BESIDE)[at] >> np.uint64(58)
    return bucket, at, around.astype(np.int64)


def settings_of(texts: list[bytes]) -> np.ndarray:
    """For each n-gram's bucket in how many different surroundings it stands, by linear counting in 64 bits: near copies of a
    text add nothing, and what stands in hundreds of them counts as some 270."""
    seen = np.zeros(1 << BITS, np.uint64)
    for b in texts:
        bucket, _, around = grams(b)
        np.bitwise_or.at(seen, bucket, np.uint64(1) << around.astype(np.uint64))
    return -64 * np.log(np.maximum(1, 64 - np.bitwise_count(seen).astype(np.float64)) / 64)


def telling_pieces(toxic: list[bytes], ordinary: list[bytes], least: float = 5.0, ratio: float = 8.0) -> list[bytes]:
    """The pieces of words in the toxic texts whose n-grams stand in `least` different surroundings there and, for as much
    text, in over `ratio` times as many as in ordinary texts. Toxic texts are ordinary words for the most part; a dictionary
    of all of them would hold what both classes share."""
    there, here = settings_of(ordinary), settings_of(toxic)
    scale = sum(map(len, toxic)) / max(1, sum(map(len, ordinary)))
    # counts near the most that can be counted may stand for any more
    tells = (here >= least) & (here > ratio * scale * (there + 0.5)) & (there < 100)
    out = []
    for b in toxic:
        bucket, at, _ = grams(b)
        inside = np.zeros(len(b) + 2, np.int8)
        for i in at[tells[bucket]]:
            inside[i + 1 : i + 1 + GRAM] = 1
        edge = np.diff(inside)
        out += [b[i:j] for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return out


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary's bytes; where there is too little to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]


class Compressors:
    """Lengths of windows under the two dictionaries. The toxic one lies in front of the ordinary one in its dictionary,
    so that what is ordinary is matched at the same distances under both and cancels out."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        self.z = z
        setting = z.ZstdCompressionParameters.from_level(3, min_match=6, strategy=z.STRATEGY_GREEDY, window_log=17, hash_log=15, chain_log=15, write_content_size=False, write_dict_id=False)
        self.both = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d + PREAMBLE, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=setting) for d in (ordinary, toxic + ordinary)]

    def gains(self, pieces: list[bytes]) -> np.ndarray:
        """By how many bytes each piece gets shorter with the toxic dictionary."""
        if not pieces:
            return np.zeros(0, np.int64)
        n = np.array([len(p) + len(PREAMBLE) + len(TAIL) for p in pieces], np.uint64)
        data = self.z.BufferWithSegments(PREAMBLE + (TAIL + PREAMBLE).join(pieces) + TAIL, np.stack([np.cumsum(n) - n, n], 1).tobytes())
        ordinary, toxic = (np.fromiter((len(x) for x in c.multi_compress_to_buffer(data)), np.int64, len(pieces)) for c in self.both)
        return ordinary - toxic

    def features(self, texts: list[str | None], most: int = 1 << 20) -> np.ndarray:
        """A row per text: 1, the logarithms of its windows and of the windows over each gain, and the gain per window.
        Texts are met some `most` bytes at a time."""
        out, pieces, owner, held = np.zeros((len(texts), len(STEPS) + 3)), [], [], 0
        counts = np.zeros((len(texts), len(STEPS) + 2))

        def flush() -> None:
            g, o = self.gains(pieces), np.array(owner, np.int64)
            counts[:, 0] += np.bincount(o, minlength=len(texts))
            counts[:, 1] += np.bincount(o, g, len(texts))
            for i, s in enumerate(STEPS):
                counts[:, 2 + i] += np.bincount(o[g >= s], minlength=len(texts))
            pieces.clear()
            owner.clear()

        for i, t in enumerate(texts):
            b = plain(t)
            for a, e in windows(b):
                pieces.append(b[a:e])
                owner.append(i)
                held += e - a
                if held > most:
                    flush()
                    held = 0
        flush()
        out[:, 0], out[:, 1] = 1, np.log(np.maximum(1, counts[:, 0]))
        out[:, 2] = counts[:, 1] / np.maximum(1, counts[:, 0])
        out[:, 3:] = np.log1p(counts[:, 2:])
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's steps, with a small ridge on all but the first column."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    ordinary: bytes  # dictionaries
    toxic: bytes
    weights: np.ndarray

    def compressors(self) -> Compressors:
        return Compressors(self.ordinary, self.toxic)

    def scores(self, texts: list[str | None], c: Compressors) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(c.features(texts) @ self.weights, -30, 30)))


def fit(toxic: list[str], ordinary: list[str], n_toxic: int, n_ordinary: int, parts: int = 3) -> ToxicityModel:
    """Dictionaries from all texts; thresholds, as a logistic curve over the counts of windows above each gain, from gains
    that each part's texts have under dictionaries of the other parts, at the shares that the classes have among all
    labelled rows (n_toxic, n_ordinary)."""
    rng = np.random.default_rng(5)

    def dictionaries(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
        bad, good = [plain(t) for t in toxic], [plain(t) for t in ordinary]
        pieces = telling_pieces(bad, good)
        common = [b[a:e] for b in good for a, e in windows(b)]
        common = [common[i] for i in rng.permutation(len(common))[:20_000]]
        return ToxicityModel(trained(common, 512, 64), trained(pieces, 8192, 16) if pieces else b"", np.zeros(len(STEPS) + 3))

    model, x, y = dictionaries(toxic, ordinary), [], []
    if min(len(toxic), len(ordinary)) < parts:
        model.weights[0] = np.log((n_toxic + 0.5) / (n_ordinary + 0.5))
        return model
    for i in range(parts):
        rest = [[t for k, t in enumerate(s) if k % parts != i] for s in (toxic, ordinary)]
        held = [toxic[i::parts], ordinary[i::parts]]
        x.append(dictionaries(*rest).compressors().features(held[0] + held[1]))
        y += [1.0] * len(held[0]) + [0.0] * len(held[1])
    labels = np.array(y)
    weight = np.where(labels == 1, n_toxic / len(toxic), n_ordinary / len(ordinary)) * len(labels) / max(1, n_toxic + n_ordinary)
    model.weights = logistic(np.concatenate(x), labels, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, most: int = 3000, longest: int = 40_000) -> ToxicityModel:
    """docs(doc_id, text), labels(doc_id, toxic) -> a model of a sample of labelled rows outside the held-out fold: the
    `most` labels of each class whose ids have the smallest hashes, of which those join whose texts have `longest`
    characters at most. The driver holds 2 * most * longest characters at most (some tens of megabytes at usual lengths).
    Labels that are null, and ids that are null, teach nothing; rows without text teach as empty texts."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != held_fold)
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}  # two rows
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = None
    for k in (0, 1):
        some = usable.where(F.col("toxic") == k).orderBy(*order).limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * most ids
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    # ids may repeat: the sample stays bounded whatever they do
    rows = rows.select("toxic", "text").orderBy(F.xxhash64("doc_id", "text")).limit(2 * most).collect()
    texts = [sorted(r.text for r in rows if r.toxic == k) for k in (0, 1)]
    rng = np.random.default_rng(3)
    mixed = [[t[i] for i in rng.permutation(len(t))] for t in texts]
    return fit(mixed[1], mixed[0], n.get(1, 0), n.get(0, 0))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> (doc_id, held_out, score, predicted), a row for each row of docs.

    Whole texts are cut into windows, each compressed under both dictionaries. An empty or null text is one window
    without gain and gets what the curve says of that; equal texts get equal scores; without labels of both classes all
    texts get the share of toxic labels (one half where there is none). Extra columns play no part."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        c = model.compressors()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist(), c), pa.float64())], names=["doc_id", "score"])
        give_back()

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    fold = F.pmod(id_crc(F.col("doc_id")), F.lit(folds))
    return out.select("doc_id", (fold == held_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
