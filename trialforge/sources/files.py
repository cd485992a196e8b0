"""Readers and writers of trial shards, scored-point text, point arrays, JSON lookups, lists, queues and manifests."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spatial import min_max

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
TRIAL_SCHEMA = T.StructType(
    [T.StructField(n, k) for n, k in [("object", _S), ("load_case", _S), ("candidate", _S), ("candidate_msh", _S), ("n_dofs", _L), ("n_cells", _L)]]
    + [T.StructField(n, _D) for n in ("energy_total", "energy_crit", "vm_p99_crit", "vm_max_crit", "max_disp", "rel_energy_err", "rel_energy_crit_err", "rel_vm_p99_err", "rel_vm_max_err", "rel_max_disp_err")]
    + [T.StructField(n, k) for n, k in [("n_crit_cells", _L), ("crit_radius", _D), ("n_crit_points", _L), ("t_candidate_s", _D), ("status", _S)]]
)
NUMBER = r"([^,;(){}\s]+)"
POINT = rf"SP\(\s*{NUMBER}\s*,\s*{NUMBER}\s*,\s*{NUMBER}\s*\)\{{\s*{NUMBER}\s*\}}"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing in every floating column."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


#: Columns without which a file holds no trials.
REQUIRED = ("object", "load_case", "candidate", "status")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def header_census(spark: SparkSession, paths: str | list[str], skip: tuple[str, ...] = ("aggregated", "done_manifest")) -> DataFrame:
    """(file, header): the first line of each CSV file below the paths; files whose names hold one of `skip`, and empty ones,
    are left out. Lines are numbered where they are read, so only a line for each piece of a file is shuffled."""
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.csv").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    for s in skip:
        lines = lines.where(~file_name(F.col("file")).contains(s))
    # numbers grow in the order of a piece's lines; the filter is under the numbering, which it doesn't disturb
    numbered = lines.where("at = 0").withColumn("n", F.monotonically_increasing_id())
    first = numbered.groupBy("file").agg(F.min_by("value", "n").alias("header"))
    return first.select("file", F.regexp_replace("header", "^\ufeff", "").alias("header"))


def header_columns(header: str) -> list[str]:
    """The column names of a header line; a name that comes again gets a number, so that the first one counts."""
    names: list[str] = []
    for n in next(csv.reader([header]), []):
        n = n.strip()
        names.append(f"{n}__{len(names)}" if n in names or not n else n)
    return names


def file_layouts(spark: SparkSession, paths: str | list[str], required: Sequence[str] = REQUIRED, skip: tuple[str, ...] = ("aggregated", "done_manifest")) -> DataFrame:
    """(header, files, missing): how many files have each header, and which required columns it lacks; read_trials leaves
    files out that lack one."""
    n = header_census(spark, paths, skip).groupBy("header").agg(F.count(F.lit(1)).alias("files"))
    names = F.transform(F.split("header", ","), lambda c: F.trim(F.btrim(F.trim(c), F.lit('"'))))
    return n.withColumn("missing", F.array_except(F.array(*[F.lit(c) for c in required]), names))


def read_trials(spark: SparkSession, paths: str | list[str], schema: T.StructType = TRIAL_SCHEMA, required: Sequence[str] = REQUIRED, skip: tuple[str, ...] = ("aggregated", "done_manifest")) -> DataFrame:
    """Trial shards below the paths with their columns of `schema`, the file and its load level.

    Headers may differ from file to file: columns go by name in any order, those that schema doesn't name are passed over,
    those that a file lacks are null, and files that lack one of `required` are left out (file_layouts counts them). Bad
    lines, files whose names hold one of `skip` and empty files are left out; ids stay strings, NaN and empty metrics are
    null. No file: no rows.

    A first pass takes the headers; files of one header are then read together with its columns typed, so there are as many
    reads as layouts, and Spark prunes columns in each. The driver holds what it lists for any read: the paths."""
    census = header_census(spark, paths, skip).groupBy("header").agg(F.collect_list("file").alias("files"))
    kinds = {f.name: f.dataType for f in schema}
    out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("file", _S)]))
    for header, listed in sorted((r.header, sorted(r.files)) for r in census.collect()):
        names = header_columns(header)
        if not set(required) <= set(names):
            continue
        layout = T.StructType([T.StructField(n, kinds.get(n, _S)) for n in names])
        # the layout states the header's own columns in its own order, so the header needs no check
        raw = spark.read.schema(layout).options(header=True, mode="DROPMALFORMED", nanValue="NaN").csv(listed)
        file = F.col("_metadata.file_path").alias("file")
        out = out.unionByName(raw.select(*[F.col(f"`{n}`") for n in names if n in kinds], file), allowMissingColumns=True)
    return nan_to_null(out.withColumn("h_scale", level_of_directory(F.col("file"))))


def level_of_directory(path: Column) -> Column:
    """The level of a directory like hs1.25/, else 1.0."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/hs([0-9]+(?:\.[0-9]+)?)/", 1), F.lit("")).cast("double"), F.lit(1.0))


def point_lines(x: str, y: str, z: str, val: str) -> Column:
    return F.concat(F.lit("SP("), F.concat_ws(",", *[F.col(c).cast("string") for c in (x, y, z)]), F.lit("){"), F.col(val).cast("string"), F.lit("};"))


def parse_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows whose text is a scored point, with x, y, z and val; other rows are left out."""
    got = lines.where(F.col(column).rlike(POINT))
    for i, name in enumerate(("x", "y", "z", "val"), 1):
        got = got.withColumn(name, F.expr(f"try_cast(regexp_extract(`{column}`, r'{POINT}', {i}) as double)"))
    return got.drop(column)


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    """Scored-point files -> (file, x, y, z, val)."""
    return parse_points(spark.read.option("recursiveFileLookup", True).text(path).withColumn("file", F.col("_metadata.file_path")))


def write_points_text(df: DataFrame, path: str, unit: list[str]) -> None:
    """One directory per unit; values are scaled to 0..1 within their unit (0 where they are all equal)."""
    scaled = min_max(df, unit, "val", "val")
    scaled.select(*unit, point_lines("x", "y", "z", "val").alias("value")).write.partitionBy(*unit).text(path)


def read_point_arrays(spark: SparkSession, path: str) -> DataFrame:
    """.npy files of shape (n, 3) -> (file, seq, x, y, z); files of another shape or with pickles are left out."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                except ValueError:
                    continue
                if a.ndim == 2 and a.shape[1] == 3:
                    yield pd.DataFrame({"file": file, "seq": np.arange(len(a)), "x": a[:, 0].astype(float), "y": a[:, 1].astype(float), "z": a[:, 2].astype(float)})

    return spark.read.format("binaryFile").options(pathGlobFilter="*.npy", recursiveFileLookup=True).load(path).select("path", "content").mapInPandas(load, "file string, seq long, x double, y double, z double")


def read_map_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of structs -> (key, fields...); value is the struct's DDL, like `h_fine double, h_max double`."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string, struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in value.split(','))}>>")).alias("key", "v")).select("key", "v.*")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Lists of `id` or `id directory` lines -> (id, directory); empty lines and # comments are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value").rlike(r"^[^#\s]")).select(parts[0].alias("id"), F.get(parts, F.lit(1)).alias("directory"))


def write_manifest(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.partitionBy(split).json(path)


def write_queue(df: DataFrame, path: str, columns: list[str]) -> None:
    """Work queue lines: the columns joined by |."""
    df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    w = df.write.partitionBy(*by) if by else df.write
    w.option("header", True).format(kind).save(path)
