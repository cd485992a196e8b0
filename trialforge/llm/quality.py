"""Quality rules with host-level verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_CHARS, cut

SYMBOLS = "[#*$%&|<>]"
#: Verdicts of up to so many hosts (some 20 MB) are broadcast.
BROADCAST_HOSTS = 200_000


def with_text_measures(docs: DataFrame, window: int = 5, hash_bits: int = 64) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) of each whole text; a null or
    empty text has 0 of each. Columns of docs stay; those of the new names are replaced.

    Repeated windows are found inside the row: each window's hash, with its place in the low bits, is sorted as a plain
    array of longs, so equal windows become neighbours. Neighbours of one hash are compared by their words; a row in
    which they differ, which is next to never, is worked out by sorting the windows themselves (fewer hash_bits are for
    tests of that)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    d = docs.withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE)))
    d = d.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("__words")
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__low": F.expr("shiftleft(1L, length(bin(size(__words)))) - 1"),  # as many low bits as places need
    })

    def keyed(i: Column) -> Column:
        h = F.xxhash64(*[F.get("__words", i + k) for k in range(window)])
        h = h if hash_bits == 64 else F.shiftleft(h, 64 - hash_bits)
        return F.coalesce(h.bitwiseAND(F.bitwise_not(F.col("__low"))).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))

    none = F.array().cast("array<bigint>")
    d = d.withColumn("__keys", F.when(n < window + 1, none).otherwise(F.transform(F.sequence(F.lit(0), n - window), keyed)))
    d = d.withColumn("__keys", F.sort_array("__keys"))

    def same(x: Column, y: Column) -> Column:
        return x.bitwiseXOR(y).between(F.lit(0), F.col("__low"))

    def words_at(key: Column) -> Column:
        return F.slice("__words", key.bitwiseAND(F.col("__low")).cast("int") + 1, window)

    clash = F.exists(F.sequence(F.lit(1), F.size("__keys") - 1), lambda i: F.when(same(F.get("__keys", i), F.get("__keys", i - 1)), words_at(F.get("__keys", i)) != words_at(F.get("__keys", i - 1))).otherwise(False))
    d = d.withColumn("__clash", F.when(F.size("__keys") > 1, clash).otherwise(False))
    fast = F.sort_array(F.transform(F.filter("__keys", lambda x, i: same(x, F.get("__keys", i + 1)) | same(x, F.get("__keys", i - 1))), lambda x: x.bitwiseAND(F.col("__low"))))
    windows = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.struct(F.slice("__words", i + 1, window).alias("g"), i.cast("long").alias("i")))
    d = d.withColumn("__windows", F.when(F.col("__clash"), F.sort_array(windows)))
    near = lambda x, i: F.coalesce(x["g"] == F.get("__windows", i)["g"], F.lit(False))
    exact = F.sort_array(F.transform(F.filter("__windows", lambda x, i: near(x, i + 1) | near(x, i - 1)), lambda x: x["i"]))
    d = d.withColumn("__at", F.when(F.col("__clash"), exact).otherwise(fast))
    steps = F.transform("__at", lambda x, i: F.least(F.lit(window).cast("long"), F.coalesce(F.get("__at", i + 1), x + window) - x))
    d = d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b))
    return d.drop("__words", "__lines", "__low", "__keys", "__clash", "__windows", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed(most_symbols: float = 0.3, most_dup_lines: float = 0.5, least_chars: float = 2.0, most_chars: float = 14.0) -> Column:
    """Whether any rule fails a document: the base rules, symbols per word, the share of repeated lines, the mean length
    of words. Counts against the host; only the base rules and the host's verdict decide on a document."""
    words = F.col("n_words")
    return base_failed() | (F.col("n_symbols") > most_symbols * words) | (F.col("n_dup_lines") > most_dup_lines * F.col("n_lines")) | (F.col("word_chars") < least_chars * words) | (F.col("word_chars") > most_chars * words)


def host_verdicts(measured: DataFrame, host: str = "source", most_failures: float = 0.5) -> DataFrame:
    """measured(host, n_words, ...) -> (host, host_docs, host_failures, host_rate, host_ok), a row for each host.

    A host's rate of failing documents is shrunk to the mean of all hosts by a beta prior whose weight is fitted by
    moments: the spread of the hosts' rates beyond what their numbers of documents explain. A host is rejected if its
    shrunk rate is over `most_failures`. Documents with a null host form one group, judged like a host."""
    hosts = measured.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(rule_failed().cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("host_failures") / F.sum("host_docs")).alias("__mean"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("__spread"),
        F.avg(1 / F.col("host_docs")).alias("__noise"),
    )
    chance = F.col("__mean") * (1 - F.col("__mean"))
    between = F.greatest(F.col("__spread") - chance * F.col("__noise"), F.lit(1e-6))
    weight = F.least(F.greatest(chance / between - 1, F.lit(1.0)), F.lit(1e4))
    shrunk = (F.col("host_failures") + weight * F.col("__mean")) / (F.col("host_docs") + weight)
    # the prior is one row
    return hosts.join(F.broadcast(prior)).withColumn("host_rate", shrunk).withColumn("host_ok", F.col("host_rate") <= most_failures).drop("__mean", "__spread", "__noise")


def judge(docs: DataFrame, host: str = "source", most_failures: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, host, ...) -> a row for each row with the columns in `carry` (doc_id), the measures, base_failed,
    host_rate and kept = not base_failed and the host is accepted. Repeated rows are judged one by one; other columns of
    docs are left out, so their names can't clash. No rows give no rows."""
    carry = ["doc_id"] if carry is None else carry
    names = list(dict.fromkeys([*carry, host]))
    measured = with_text_measures(docs.select(*dict.fromkeys([*names, "text"])))
    measured = measured.select(*names, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    measured = cut(measured)  # else each text is measured twice
    verdicts = cut(host_verdicts(measured, host, most_failures).select(F.col(host).alias("__host"), "host_rate", "host_ok"))
    if verdicts.count() <= BROADCAST_HOSTS:  # else rows meet their host's verdict in a shuffle, in which Spark splits hot hosts
        verdicts = F.broadcast(verdicts)
    judged = measured.join(verdicts, measured[host].eqNullSafe(F.col("__host")), "left").drop("__host")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("host_ok")


def keep_good(docs: DataFrame, host: str = "source", most_failures: float = 0.5) -> DataFrame:
    """docs without the rejected documents; all columns stay as they are."""
    # the columns of docs are carried in one struct, so that no measure can clash with them
    packed = docs.select("text", F.col(host), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("__row"))
    good = judge(packed, host, most_failures, ["__row"]).where("kept")
    return good.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
