"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import new_folder
from ..streaming import shards
from .registry import query


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_shards(spark, d):
    """Totals by event type, by micro-batches over the table's files."""
    e = spark.read.parquet(f"{d}/events.parquet")
    at = new_folder(spark, "stream")
    e.repartition(4, "event_id").write.parquet(at + "/in")
    stream = shards.read_shards(spark, at + "/in", e.schema, files_per_batch=2)
    shards.refresh(stream, ["event_type"], "value", at + "/out", at + "/state").awaitTermination()
    out = spark.read.parquet(at + "/out")
    return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total, 2 as runs from events where event_id % 5 <> 0 group by 1")
def stream_restart(spark, d):
    """Workers append shards, the stream ends, more shards come and it goes on from its checkpoint: shards that were read
    aren't read again. Rows that repeat (here every third one comes twice) count once, by the state of their keys."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_id % 5 <> 0").withColumn("ts", F.col("ts").cast("timestamp"))
    at = new_folder(spark, "stream")
    parts = [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").unionByName(e.where("event_id % 3 = 0"))]
    for part in parts:
        part.repartition(2, "event_id").write.mode("append").parquet(at + "/in")
        stream = shards.first_rows(shards.read_shards(spark, at + "/in", e.schema, files_per_batch=1), ["event_id"], "ts", "4000 days")
        shards.append_rows(stream, at + "/rows", at + "/state").awaitTermination()
    rows = spark.read.parquet(at + "/rows")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("runs", F.lit(len(parts)))


@query("select user_id, count(*) as n from events where event_type <> 'error' and user_id not in (select user_id from events where event_type = 'purchase' and event_id % 3 = 0) group by 1")
def resume_pending(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    done = e.where("event_type = 'purchase' and event_id % 3 = 0").select("user_id", F.lit("ok").alias("status"))
    return shards.pending(e.where("event_type <> 'error'"), done, ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id % 8 as worker, count(value) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, max(event_id) as last from events group by 1")
def stream_running(spark, d):
    """Means, counts and last progress by worker while shards still come: the stream stops half-way and goes on from its
    state."""
    now = worker_totals(spark, d)
    return now.select("worker", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.col("last.at").alias("last"))


def worker_totals(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    at = new_folder(spark, "stream")
    # each event is a line of its worker's log: so many of so many done
    log = e.select((F.col("user_id") % 8).alias("worker"), "value", F.struct(F.col("event_id").alias("at"), (F.col("event_id") % 50).alias("done"), F.lit(50).cast("long").alias("total")).alias("step"))
    for part in (log.where("step.at % 2 = 0"), log.where("step.at % 2 = 1")):
        part.repartition(3, "step").write.mode("append").parquet(at + "/in")
        stream = shards.read_shards(spark, at + "/in", log.schema, files_per_batch=2)
        shards.running(stream, ["worker"], "value", "step", at + "/out", at + "/state").awaitTermination()
    return shards.latest(spark.read.parquet(at + "/out"), ["worker"])


@query("select count(*) as workers, cast(sum(last % 50) as bigint) as done, cast(50 * count(*) as bigint) as total, round(100.0 * sum(last % 50) / (50 * count(*)), 4) as percent from (select user_id % 8 as worker, max(event_id) as last from events group by 1)")
def stream_progress(spark, d):
    """How far all workers are, by the last line of progress of each."""
    return shards.progress(worker_totals(spark, d))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from (select event_type, user_id, min(value) as value from events where event_id % 3 <> 1 group by 1, 2) group by 1")
def stream_resume(spark, d):
    """Tasks come again and again, in other shards and after a restart; each key is worked on once, in the stream."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_id % 3 <> 1").select("event_type", "user_id", F.min("value").over(Window.partitionBy("event_type", "user_id")).alias("value"), "event_id")
    at = new_folder(spark, "stream")
    for part in (e.where("event_id % 3 = 0"), e.where("event_id % 3 = 2")):
        part.repartition(2, "event_id").write.mode("append").parquet(at + "/in")
        stream = shards.read_shards(spark, at + "/in", e.schema, files_per_batch=1)
        shards.resume(stream, ["event_type", "user_id"], at + "/done", at + "/state").awaitTermination()
    return spark.read.parquet(at + "/done").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
