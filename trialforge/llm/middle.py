"""Fill-in-the-middle: texts are cut into units and put together as prefix, suffix and middle, in pyarrow.compute."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: The control strings, and what a unit is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "([A-Za-z]+|[^A-Za-z])"
#: Bytes of text that are cut into units at a time; a longer text is met alone.
PART_BYTES = 1 << 20
NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def separator(texts: pa.Array) -> str:
    """The first code point that none of the texts holds, but for the backslash, which the marking would read as its own."""
    code = 1
    while chr(code) == "\\" or pc.any(pc.match_substring(texts, chr(code))).as_py():
        code = 0xE000 if code == 0xD7FF else code + 1
    return chr(code)


def units_of(texts: pa.Array) -> pa.Array:
    """Lists of the units of each text; an empty text has one empty piece."""
    mark = separator(texts)
    marked = pc.replace_substring_regex(texts, UNIT, rf"\1{mark}")
    return pc.split_pattern(pc.utf8_rtrim(marked, mark), mark)


def remainder(x: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def rearrange(batch: pa.RecordBatch, plain_share: int, spm_share: int) -> pa.RecordBatch:
    """batch(doc_id, text, h1, h2, h3, h4) -> NAMES. Units are flattened with their parents and numbered inside them; each
    role's units are filtered out and become lists, and so texts, again."""
    text = pc.fill_null(batch.column("text"), "")
    units = units_of(text)
    size = pc.list_value_length(units).cast(pa.int64())
    n = pc.if_else(pc.equal(text, ""), 0, size)
    cuts = [remainder(batch.column(h), pc.add(n, 1)) for h in ("h1", "h2")]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    begins = pc.subtract(pc.cumulative_sum(size), size)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(begins, parent))
    in_prefix, in_suffix = pc.less(ordinal, pc.take(low, parent)), pc.greater_equal(ordinal, pc.take(high, parent))

    def joined(role: pa.Array, count: pa.Array) -> pa.Array:
        ends = pc.cumulative_sum(count).cast(pa.int32())
        lists = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pc.filter(flat, role))
        return pc.binary_join(lists, "")

    prefix = joined(in_prefix, low)
    middle = joined(pc.invert(pc.or_(in_prefix, in_suffix)), pc.subtract(high, low))
    suffix = joined(in_suffix, pc.subtract(size, high))
    plain = pc.equal(text, "")
    for control in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, control))
    plain = pc.or_(plain, pc.greater_equal(remainder(batch.column("h3"), pa.scalar(100, pa.int64())), plain_share))
    spm = pc.less(remainder(batch.column("h4"), pa.scalar(100, pa.int64())), spm_share)
    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    output = pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, form, *chars, output], names=NAMES)


def fill_in_middle(docs: DataFrame, plain_share: int = 90, spm_share: int = 20, seed: int = 1) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output), a row for each row.

    A text of n units is cut at two places drawn by the hash of seed and id. Where the draw is at or over plain_share of 100,
    and for texts that are empty or hold a control string, the output is the text; else spm_share of 100 come as suffix,
    prefix, middle, and the others as prefix, suffix, middle. A null text is an empty one, a null id hashes as an empty
    text; repeated rows get equal results. Extra columns play no part. Texts are whole, of any length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES, side="right")))
                yield rearrange(batch.slice(at, end - at), plain_share, spm_share)
                at = end
        give_back()

    return docs.select("doc_id", "text", *numbers).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form"):
    """The exact text that an output was made of: only control strings part its pieces."""
    pieces = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    piece = lambda k: F.get(pieces, F.lit(k))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(F.concat(piece(1), piece(3), piece(2)))


def digests(made: DataFrame) -> DataFrame:
    """What fill_in_middle wrote, with checksums of the output and of the text restored from it in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
