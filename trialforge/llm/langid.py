"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, id_crc, start_afresh

BITS = 15
#: A text is ambiguous if its second codeword costs less than this more per bit.
UNCLEAR = 0.05


def gram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the byte trigrams of the lower-cased text with a space before and after it."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b"  ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1. Up to 5 classes get the exhaustive code (each split of the classes is a bit), more get a dense
    random code of which no bit is constant and no two rows are equal."""
    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= 5:
        cols = [[1] + [1 if (c >> i) & 1 else -1 for i in range(n - 1)] for c in range(2 ** max(0, n - 1) - 1)]
        return np.array(cols, np.float32).reshape(-1, n).T
    rng, length = np.random.default_rng(seed), 16 + 8 * int(np.ceil(np.log2(n)))
    while True:
        m = rng.choice([-1, 1], (n, length)).astype(np.float32)
        m = m[:, np.abs(m.sum(0)) < n]
        if len(np.unique(m, axis=0)) == n:
            return m


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of each bit

    def margins(self, text: str) -> np.ndarray:
        g = gram_buckets(text)
        if len(g) > 1 << BITS:
            return (np.bincount(g, minlength=1 << BITS).astype(np.float32) @ self.weights) / len(g)
        return self.weights[g].sum(0) / len(g)

    def decode(self, text: str | None, steep: float = 12.0) -> tuple[str, float, float]:
        """(language, score, gap). Each codeword costs the sum of the logistic losses of its bits, a bit's loss weighted
        by the classifier's margin; the least wins (ties: the first language). The score is the winner's share of
        exp(-loss), the gap its lead over the second, per bit."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 1.0
        loss = np.logaddexp(0.0, -steep * self.codes * self.margins(text)).sum(1)
        best, second = np.argsort(loss, kind="stable")[:2]
        share = np.exp(loss[best] - loss)
        return self.languages[best], float(1 / share.sum()), float((loss[second] - loss[best]) / self.codes.shape[1])


def train(docs: DataFrame) -> LanguageModel:
    """docs(text, lang): counts of n-grams per language over all of docs; rows with a null text or lang teach nothing.

    Each bit gets a naive Bayes classifier: the log odds of a bucket between the languages whose codewords have a 1
    there and the others, each language with equal weight. Each task adds its texts' n-grams up, sums meet by bucket,
    and a bucket's weights are worked out next to them: the driver gets a total for each language and 2**15 rows of
    as many weights as codewords have bits (some tens, by the logarithm of the number of languages)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_afresh()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, np.int64)
                g = gram_buckets(text.as_py())
                if len(g) > 4000:
                    sums[lang] += np.bincount(g, minlength=1 << BITS)
                else:
                    np.add.at(sums[lang], g, 1)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "bucket", "n"])

    known = docs.select("text", "lang").where("text is not null and lang is not null")
    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = cut(sums)
    totals = sorted((r[0], r[1]) for r in sums.groupBy("lang").agg(F.sum("n")).toLocalIterator())
    languages = [x for x, _ in totals]
    codes, scale = codewords(len(languages)), 1 / (np.array([n for _, n in totals], float) + 0.5 * (1 << BITS))
    ones, bits = codes > 0, codes.shape[1]
    weights = np.zeros((1 << BITS, bits), np.float32)
    if not bits:
        return LanguageModel(languages, codes, weights)
    rest = np.stack([0.5 * scale @ ones, 0.5 * scale @ ~ones])  # what languages give to a bucket that they don't have
    sizes = np.stack([ones.sum(0), (~ones).sum(0)])
    held = docs.sparkSession.sparkContext.broadcast((ones, scale, rest, sizes, {x: i for i, x in enumerate(languages)}))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, scale, rest, sizes, at = held.value
        for batch in batches:
            out = []
            for seen in batch.column("seen"):
                x = sorted((at[r["lang"]], r["n"]) for r in seen.as_py())
                rows = np.array([i for i, _ in x])
                rate = np.array([n for _, n in x]) * scale[rows]
                means = (rest + np.stack([rate @ ones[rows], rate @ ~ones[rows]])) / sizes
                out.append(np.log(means[0] / means[1]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(out, pa.binary())], names=["bucket", "w"])

    weights[:] = np.log(rest[0] / sizes[0] / (rest[1] / sizes[1]))
    fitted = sums.groupBy("bucket").agg(F.collect_list(F.struct("lang", "n")).alias("seen")).mapInArrow(fit, "bucket int, w binary")
    for r in fitted.toLocalIterator():
        weights[r.bucket] = np.frombuffer(r.w, np.float32)
    held.destroy()
    return LanguageModel(languages, codes, weights)


def predict(docs: DataFrame, model: LanguageModel, unclear: float = UNCLEAR) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score, ambiguous), a row for each row. A text that is null or has no
    letters is `und` with score 0. ambiguous: the second codeword costs less than `unclear` more per bit."""
    kind, held = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            found = [m.decode(t.as_py()) for t in batch.column(1)]
            lang, score, gap = ([x[i] for x in found] for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([g < unclear for g in gap], pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Learns from the documents outside the held-out fold and predicts all: (doc_id, held_out, lang_pred, score,
    ambiguous). No labelled documents: all are `und`."""
    fold = F.pmod(id_crc(F.col("doc_id")), F.lit(folds))
    model = train(docs.where(fold != held_fold))
    return predict(docs, model).withColumn("held_out", F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) == held_fold)


def keep_identified(docs: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """docs without the documents whose language is `und` or ambiguous. All columns stay as they are. The verdict is
    made next to the row, so nothing is joined and repeated rows are judged one by one."""
    model = train(docs.where(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != held_fold))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            found = (m.decode(t.as_py()) for t in batch.column("text"))
            yield batch.filter(pa.array([lang != "und" and gap >= UNCLEAR for lang, _, gap in found], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
