"""Token counts attributed to fields and sections of documents that are encoded once as a whole."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_path

#: Runs of white space (by the Unicode property) that the pattern's engine can't be trusted with.
LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")

_ENCODERS: dict[str, tuple] = {}


def encoder(path: str) -> tuple:
    """(encoding, bytes of each token); one per Python worker and file."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _ENCODERS[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODERS[path]


def encode(encoding, text: str) -> list[int]:
    """Ids of a whole text. A long run of white space goes to the merges by itself, as the pattern would have it: all of
    it at the end of the text, else all but its last character."""
    ids, at = [], 0
    for m in LONG_WHITE.finditer(text):
        end = m.end() - (m.end() < len(text))
        ids += encoding.encode_ordinary(text[at : m.start()])
        ids += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def spans_of_lines(text: bytes) -> np.ndarray:
    """Byte offsets at which lines begin; a line holds the \\n that ends it, and a text that ends in \\n has no line after."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate(([0], ends[ends < len(text)]))


def attribute(starts: np.ndarray, sections: np.ndarray, size: int, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens (byte offsets `starts`, each ends where the next begins) with sections (the same), both
    sorted, over a text of `size` bytes. Returns (tokens per section, crossing tokens per section): a token that crosses
    a boundary counts whole for the section of its first byte (rule `first`), of its last byte (`last`), or of most
    of its bytes, on ties the first (`most`)."""
    n = len(sections)
    first = np.searchsorted(sections, starts, side="right") - 1
    ends = np.append(starts[1:], size)
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    owner = last if rule == "last" else first.copy()
    cross = np.flatnonzero(first != last)
    if rule == "most":
        bounds = np.append(sections, size)
        for t in cross:
            parts = np.arange(first[t], last[t] + 1)
            inside = np.minimum(ends[t], bounds[parts + 1]) - np.maximum(starts[t], bounds[parts])
            owner[t] = parts[np.argmax(inside)]
    return np.bincount(owner, minlength=n), np.bincount(owner[cross], minlength=n)


def section_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, fields...) -> (doc_id, field, section, start_char, n_chars, n_tokens, n_crossing), one row per line
    of each field of each row.

    The fields of a row are joined by \\n, the whole is encoded once, and each token goes to one line by its offsets, so
    the rows of a document add up to its tokens. A null field is an empty text; each field has a line at least (an empty
    one has no characters and no tokens). Positions are code points in the joined text. Repeated rows repeat."""
    path, kind, n_fields = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken"), docs.schema["doc_id"].dataType.simpleString(), len(fields)
    names = ["doc_id", "field", "section", "start_char", "n_chars", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(path)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for k in range(batch.num_rows):
                texts = [batch.column(1 + i)[k].as_py() or "" for i in range(n_fields)]
                raw = [t.encode("utf-8", "replace") for t in texts]
                begins, fields_of, at = [], [], 0
                for i, r in enumerate(raw):
                    lines = spans_of_lines(r)
                    begins.append(lines + at)
                    fields_of.append(np.full(len(lines), i))
                    at += len(r) + 1
                whole = b"\n".join(raw)
                sections, owner = np.concatenate(begins), np.concatenate(fields_of)
                # an empty last field begins behind the text; an empty text has one empty line
                ids = np.asarray(encode(encoding, "\n".join(texts)), np.int64)
                size = len(whole)
                token_ends = np.cumsum(sizes[ids])
                tokens, crossing = attribute(token_ends - sizes[ids], sections, size, rule) if len(ids) else (np.zeros(len(sections), int),) * 2
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)))
                bounds = chars[np.minimum(np.append(sections, size), size)]
                for out, x in zip(parts, (np.full(len(sections), k), owner, np.arange(len(sections)), bounds[:-1], np.diff(bounds), tokens, crossing), strict=True):
                    out.append(x)
            if batch.num_rows:
                flat = [np.concatenate(p).astype(np.int64) for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat[0])), *(pa.array(x) for x in flat[1:])], names=names)

    return docs.select("doc_id", *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(
        run, f"doc_id {kind}, field long, section long, start_char long, n_chars long, n_tokens long, n_crossing long"
    )
