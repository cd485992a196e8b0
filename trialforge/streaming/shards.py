"""Trial shards as a stream: deduplicated rows and aggregates that are refreshed while workers still append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_shards(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"*.{kind}").format(kind).load(path)


def first_rows(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows without repeats of a key; a key's state is dropped once the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def refresh(stream: DataFrame, keys: list[str], value: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps (keys, n, total) in a table: each micro-batch's partial sums are appended under its number, so that a batch
    that runs again replaces its own file and no row counts twice. Ends when all files that are there are read."""

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running(stream: DataFrame, keys: list[str], value: str, step: str, path: str, checkpoint: str) -> StreamingQuery:
    """Refreshes (keys, n, total, mean, last) of all rows so far: a stateful aggregate in update mode, whose state and place
    in the stream lie in the checkpoint. Each micro-batch writes the groups that it changed under its number, so a batch
    that runs again replaces its own rows; `latest` reads what holds now. last is the value of `step`, a struct, that is
    the largest so far, like (time, done, total) of a worker's progress. Null values don't count in n, total and mean."""
    sums = stream.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(step).alias("last"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sums.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of what `running` wrote, each group's row of the last batch that changed it."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("now")).select(*keys, "now.*")


def progress(now: DataFrame, last: str = "last") -> DataFrame:
    """One row: workers, done, total and percent over the last progress of all workers, from `latest` with last(.., done, total)."""
    s = now.agg(F.count(last).alias("workers"), F.sum(f"{last}.done").alias("done"), F.sum(f"{last}.total").alias("total"))
    return s.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * F.col("done") / F.col("total"), 4)))


def resume(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Tasks of a stream that aren't done yet go to `path`, which is the table of done keys, too: in each micro-batch repeats
    of a key count once, and what any earlier batch has done is dropped by an anti join. A batch that runs again looks at
    batches before its own only and replaces its own rows. Null keys are never done."""

    def work(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys) if keys else batch
        if number:
            done = batch.sparkSession.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).parquet(path).where(F.col("batch") < number)
            rows = rows.join(done.select(*keys).distinct(), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream's rows to a table; the checkpoint tells what was read, so a restart goes on behind it."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose key isn't among those done with status ok; null keys are never done."""
    return tasks.join(done.where(F.col("status") == "ok").select(*keys).distinct(), keys, "left_anti")
