"""Queries that write the given tables as the files that the library reads, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from ..sources.tables import cut, new_folder
from .points import P, points, r6
from .registry import query
from .trials import LEVELS, TRIALS, trials

FIELDS = ["object", "load_case", "method", "vm", "en", "n_cells", "status"]


@query("select h_scale, load_case, count(*) as n, count(vm) as n_vm, round(sum(vm), 6) as vm, cast(sum(case when seq % 3 = 1 then null else n_cells end) as bigint) as cells, min(object) as first, 2 as layouts, 1 as left_out from trials where seq % 7 <> 3 group by 1, 2", trials=TRIALS)
def trial_files(spark, d):
    """Trial shards as CSV below directories of their levels, in layouts that drift: another order with a column more and
    one less, and one without a required column, beside aggregated files that readers leave out."""
    t, at = trials(spark, d), new_folder(spark, "trials")
    # ids with leading zeros must come back as they are
    t = t.withColumn("object", F.concat(F.lit("00"), "object"))
    moved = ["note", *[f for f in reversed(FIELDS) if f != "n_cells"]]
    t = cut(t.withColumn("note", F.lit("a, note")).select("seq", "h_scale", "note", *FIELDS))
    for h in LEVELS:
        folder, level = at if h == 1.0 else f"{at}/hs{h}", t.where(F.col("h_scale") == h)
        put = lambda rows, columns, folder=folder: rows.select(*columns).write.mode("append").option("header", True).csv(f"{folder}/shards")
        put(level.where("seq % 7 <> 3 and seq % 3 <> 1"), FIELDS)
        put(level.where("seq % 7 <> 3 and seq % 3 = 1"), moved)
        put(level.where("seq % 7 = 3"), [f for f in FIELDS if f != "status"])
    schema = T.StructType([T.StructField(n, T.StringType() if n in ("object", "load_case", "method", "status") else T.DoubleType()) for n in FIELDS])
    needed = ["object", "load_case", "method", "status"]
    got = files.read_trials(spark, at, schema, needed)
    whole = F.size("missing") == 0
    layouts = files.file_layouts(spark, at, needed).agg(F.count_if(whole).alias("layouts"), F.count_if(~whole).alias("left_out"))
    first = F.min(F.substring("object", 3, 20)).alias("first")
    out = got.groupBy("h_scale", "load_case").agg(F.count(F.lit(1)).alias("n"), F.count("vm").alias("n_vm"), r6(F.sum("vm"), "vm"), F.sum("n_cells").cast("long").alias("cells"), first)
    return out.join(F.broadcast(layouts))  # one row


@query("select unit, count(*) as n, round(sum(s), 4) as total, min(s) as least, max(s) as most from (select unit, (val - min(val) over w) / (max(val) over w - min(val) over w) as s from points window w as (partition by unit)) group by 1", **P)
def point_files(spark, d):
    """Scored points as text, one directory for each unit, with values scaled in it."""
    at = new_folder(spark, "points")
    files.write_points_text(points(spark, d).select("unit", "x", "y", "z", "val"), at, ["unit"])
    got = files.read_points_text(spark, at).withColumn("unit", F.regexp_extract("file", "unit=([0-9]+)", 1).cast("long"))
    return got.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 4).alias("total"), F.min("val").alias("least"), F.max("val").alias("most"))


@query("select n_name as nation, count(*) as n, round(sum(c_acctbal * (1 + n_nationkey / 100.0e0)), 2) as scaled from customer join nation on c_nationkey = n_nationkey where n_regionkey in (1, 3) group by 1")
def lookup_files(spark, d):
    """Customers joined to a JSON object of structs, where a list of ids (with comments and directories) has their nation."""
    nation, at = spark.read.parquet(f"{d}/nation.parquet"), new_folder(spark, "lookup")
    one = F.map_from_entries(F.collect_list(F.struct("n_name", F.struct((1 + F.col("n_nationkey") / 100.0).alias("factor"), F.col("n_nationkey").cast("double").alias("number")))))
    nation.agg(F.to_json(one).alias("value")).write.text(at + "/json")  # 25 nations
    lines = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_nationkey", F.lit("  some/directory"))).otherwise(F.col("n_nationkey").cast("string"))
    comment = spark.range(1).select(F.lit("# nations of two regions").alias("value"))
    nation.where("n_regionkey in (1, 3)").select(lines.alias("value")).unionByName(comment).write.text(at + "/ids")
    table = files.read_map_json(spark, at + "/json", "factor double, number double")
    ids = files.read_ids(spark, at + "/ids").select(F.col("id").cast("long").alias("id"))
    c = spark.read.parquet(f"{d}/customer.parquet").join(ids, F.col("c_nationkey") == F.col("id"), "left_semi")
    j = c.join(table, F.col("c_nationkey") == F.col("number"))
    return j.groupBy(F.col("key").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal").cast("double") * F.col("factor")), 2).alias("scaled"))


@query("select split, count(*) as n, cast(sum(seq) as bigint) as total, count(distinct object || '|' || load_case || '|' || method) as queued from (select *, case when user_id % 4 = 0 then 'val' else 'train' end as split from trials where status <> 'ok') group by 1", trials=TRIALS)
def work_files(spark, d):
    """A manifest as JSON by split, and a queue of lines joined by |, both read back."""
    t, at = trials(spark, d).where("status <> 'ok'"), new_folder(spark, "work")
    t = cut(t.withColumn("split", F.when(F.col("user_id") % 4 == 0, "val").otherwise("train")))
    files.write_manifest(t.select("split", "seq", "object"), at + "/manifest")
    files.write_queue(t.select("split", "object", "load_case", "method").distinct(), at + "/queue", ["split", "object", "load_case", "method"])
    kept = spark.read.schema("seq long, object string, split string").json(at + "/manifest").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total"))
    lines = F.split("value", r"\|")
    queued = spark.read.text(at + "/queue").where(F.size(lines) == 4).groupBy(lines[0].alias("split")).agg(F.count(F.lit(1)).alias("queued"))
    return kept.join(queued, "split")


@query("select o_orderpriority as priority, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderstatus <> 'P' group by 1")
def table_files(spark, d):
    """A table written by partition and as CSV, and read back by one partition's filter."""
    o, at = spark.read.parquet(f"{d}/orders.parquet").select("o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice")), new_folder(spark, "tables")
    files.write_table(o, at + "/parquet", by=["o_orderstatus"])
    files.write_table(spark.read.parquet(at + "/parquet").where("o_orderstatus <> 'P'").select("o_orderpriority", "o_totalprice"), at + "/csv", "csv")
    got = spark.read.schema("o_orderpriority string, o_totalprice double").option("header", True).csv(at + "/csv")
    return got.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
