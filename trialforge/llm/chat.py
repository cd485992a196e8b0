"""Chat formatting: reply trees, their root-to-leaf paths by self-joins, and one training conversation per chosen path."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the template: a turn is START role \n text END \n.
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string is left: each begins with <|, which becomes <\\| (and \\ becomes \\\\)."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[int], list[int]]:
    """(text, starts, lengths) of a conversation; starts and lengths are the loss mask: the escaped texts of assistant
    turns, in code points. A null role or text is empty; a line break in a role is written \\n."""
    parts, starts, lengths, at = [], [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
        body = escape(text or "")
        if role == "assistant":
            starts.append(at + len(head))
            lengths.append(len(body))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), starts, lengths


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation was made of."""
    return [(ESCAPED.sub(lambda x: "\n" if x[1] == "n" else x[1], m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def turns_as_replies(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> messages(conv_id, msg_id, parent_id, role, text, score): each turn answers the
    one before. Equal turn numbers are ordered by role, then text (nulls first); repeated rows are turns of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return turns.select("conv_id", "role", "text", n.alias("msg_id")).select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def leaf_paths(messages: DataFrame) -> DataFrame:
    """messages(conv_id, msg_id, parent_id) -> (conv_id, leaf, msg_id, up): all root-to-leaf paths, one row for each node
    on one, `up` steps above the leaf.

    The self-joins double their reach: round k joins in what lies 2**k steps up, so a tree of depth d takes log2(d)
    rounds. A message whose parent is null or missing is a root; a cycle of replies raises ValueError."""
    nodes = messages.select("conv_id", "msg_id").distinct()
    parent = messages.where("parent_id is not null").select("conv_id", "msg_id", F.col("parent_id").alias("above"))
    # a parent that isn't there ends the path
    up = cut(parent.join(nodes.withColumnRenamed("msg_id", "above"), ["conv_id", "above"], "left_semi").select("conv_id", "msg_id", "above"))
    inner = up.select("conv_id", F.col("above").alias("msg_id")).distinct()
    paths = cut(nodes.join(inner, ["conv_id", "msg_id"], "left_anti").select("conv_id", F.col("msg_id").alias("leaf"), "msg_id", F.lit(0).cast("long").alias("up")))
    step, edges = 1, up.count()
    while not up.isEmpty():
        if step > 2 * (edges + 1):
            raise ValueError("a cycle of replies")
        more = paths.join(up, ["conv_id", "msg_id"]).select("conv_id", "leaf", F.col("above").alias("msg_id"), (F.col("up") + step).alias("up"))
        paths = cut(paths.unionByName(more))
        next_up = up.select("conv_id", F.col("msg_id").alias("low"), F.col("above").alias("msg_id"))
        up = cut(next_up.join(up, ["conv_id", "msg_id"]).select("conv_id", F.col("low").alias("msg_id"), "above"))
        step *= 2
    return paths


def best_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, leaf): of each conversation the path with the highest mean score, on ties the longer, then the one with
    the smaller leaf. A null score counts as 0."""
    scored = paths.join(messages.select("conv_id", "msg_id", F.coalesce("score", F.lit(0.0)).alias("score")), ["conv_id", "msg_id"])
    branches = scored.groupBy("conv_id", "leaf").agg((-F.avg("score")).alias("loss"), (-F.count(F.lit(1))).alias("short"))
    return branches.groupBy("conv_id").agg(F.min(F.struct("loss", "short", "leaf")).alias("best")).select("conv_id", F.col("best.leaf").alias("leaf"))


def format_trees(messages: DataFrame) -> DataFrame:
    """messages(conv_id, msg_id, parent_id, role, text, score) -> (conv_id, formatted, loss_starts, loss_lengths): the
    best path of each conversation as one text with its loss mask. Messages with a null conv_id are one conversation;
    those with a null msg_id are left out; msg_id must be unique within a conversation. Other columns play no part."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    # inside a struct a null id equals itself
    messages = cut(messages.where("msg_id is not null").select(F.struct("conv_id").alias("conv_id"), "msg_id", "parent_id", "role", "text", "score"))
    paths = leaf_paths(messages)
    chosen = paths.join(best_paths(messages, paths), ["conv_id", "leaf"], "left_semi")
    turns = chosen.join(messages, ["conv_id", "msg_id"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), "role", "text"))).alias("turns"))
    turns = turns.select("conv_id.conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in x.as_py()]) for x in batch.column(1)]
            text, starts, lengths = ([m[i] for m in made] for i in range(3))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(starts, longs), pa.array(lengths, longs)], names=["conv_id", "formatted", "loss_starts", "loss_lengths"])

    return turns.mapInArrow(run, f"conv_id {kind}, formatted string, loss_starts array<long>, loss_lengths array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """What format_trees wrote, read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, lengths in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[a : a + n]) for a, n in zip(starts, lengths, strict=True))
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            n, turns_sha, chars, loss_sha, size = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())], names=names)

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_lengths").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
