"""URL filters: rules first, then trust and distrust propagated over the graph of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones the first given wins."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):  # what is put on last wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> (src, dst, weight): how many links lead from one host to another. Links inside a host and
    pages without a host carry nothing over the graph and are left out."""
    # a link's tag ends at the next < at the latest, so that tags that never close cost no more than their length
    link = r"""(?i)<a\s[^<>]*?(?<![\w-])href\s*+=\s*+["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
    out = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(link), 1)).alias("dst"))
    return out.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """edges(src, dst, weight), seeds(host, seed) -> (host, rank): rank = (1 - damping) * seed + damping * what flows in,
    a host's rank being split over its outgoing edges by weight; hosts without any keep nothing. Seeds aren't scaled, so
    ranks of two calls compare. Ends when no rank moves by over tolerance x the sum of seeds, or after `rounds`."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = cut(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("part")))
    base = cut(seeds.select("host", (F.col("seed") * (1 - damping)).alias("base")))
    ranks = base.select("host", F.col("base").alias("rank"))
    if flow.isEmpty():
        return ranks
    most = (base.agg(F.sum("base")).first()[0] or 0.0) / (1 - damping) * tolerance
    for _ in range(rounds):
        come = flow.join(ranks, flow.src == ranks.host).groupBy("dst").agg(F.sum(F.col("part") * F.col("rank")).alias("come"))
        new = base.join(come, base.host == come.dst, "full").select(F.coalesce("host", "dst").alias("host"), (F.coalesce("base", F.lit(0.0)) + damping * F.coalesce("come", F.lit(0.0))).alias("rank"))
        new = cut(new)
        moved = new.join(ranks.withColumnRenamed("rank", "old"), "host", "left").agg(F.max(F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))))).first()[0]
        ranks = new
        if moved is None or moved <= most:
            break
    return ranks


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, ratio: float = 2.0, rounds: int = 20) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, host, path, rule, verdict, trust, distrust), a row for each row.

    Pages that a rule allows or blocks seed their hosts; trust flows along links, distrust against them (who links to
    bad hosts is suspect). A page without a rule is blocked if its host's distrust is over `ratio` times its trust;
    hosts that neither reaches, and pages without a host, are allowed. Repeated rows count as pages of their own."""
    rules = RULES if rules is None else rules
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    judged = split.withColumns({"rule": rule, "said": said})
    edges = cut(host_edges(split))
    seeds = cut(judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").cast("double").alias("good"), F.count_if(F.col("said") == "block").cast("double").alias("bad")))
    trust = personalised_rank(edges, seeds.where("good > 0").select("host", F.col("good").alias("seed")), rounds=rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(back, seeds.where("bad > 0").select("host", F.col("bad").alias("seed")), rounds=rounds)
    hosts = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    zero = F.lit(0.0)
    out = judged.drop("html").join(hosts, "host", "left").withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    by_host = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", by_host).alias("verdict"), "trust", "distrust")
