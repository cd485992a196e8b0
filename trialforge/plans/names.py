"""Queries over paths, codes, view names and further forms of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as X
from ..sources.files import level_of_directory
from .labels import C1, CANDIDATES, REPLY, view
from .points import P, points
from .registry import query
from .trials import TRIALS, trials
from .viewsets import VIEWS, views

PATHS = """select seq, object, load_case, h_scale, 'runs/hs' || cast(h_scale as varchar) || '/shard' || cast(seq % 8 as varchar) || '/' || object || '_' || load_case
  || case when seq % 3 = 0 then '_amberfd_h' when seq % 3 = 1 then '_amberf_h' else '_plain_h' end
  || case when h_scale = 1.0 then '100' when h_scale = 1.25 then '125' when h_scale = 1.6 then '160' else '200' end || '.csv' as path from trials"""
Q1 = {"trials": TRIALS, "paths": PATHS}
MARKED = REPLY.replace("as reply", "|| ' SUMMARY ***I.C.E: 999***' as reply")
CELLS = """select seq, object, 'text. Identified cell numbers: {''concave'': [' || cast(seq % 121 as varchar) || ', ' || cast(seq % 7 as varchar) || '], ''holes'': ['
  || case when seq % 3 = 0 then '' else cast(seq % 11 as varchar) end || ']} end' as reply from trials"""


def paths(spark, d) -> DataFrame:
    return view(spark, d, PATHS)


@query("select h_scale as level, 'shard' || cast(seq % 8 as varchar) as shard, count(*) as n from paths group by 1, 2", **Q1)
def level_from_directory(spark, d):
    p = paths(spark, d).withColumn("dir", X.path_parts(F.col("path"))[0])
    return p.groupBy(level_of_directory(F.col("path")).alias("level"), F.substring_index("dir", "/", -1).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("select seq, case when seq % 3 = 0 then 'dense' when seq % 3 = 1 then 'fine' end as variant, case when seq % 3 < 2 then h_scale end as level from paths", **Q1)
def suffix_codes(spark, d):
    variant, level = X.suffix_codes(X.path_parts(F.col("path"))[2])
    return paths(spark, d).select("seq", variant.alias("variant"), level.alias("level"))


@query("select seq, object, load_case from paths", **Q1)
def split_object_load(spark, d):
    """Objects and load cases from file names; the longest load case that fits is taken."""
    stem = F.regexp_replace(X.path_parts(F.col("path"))[2], r"_[a-z]+_h[0-9]{3}$", "")
    obj, load = X.object_and_load(stem)
    return paths(spark, d).select("seq", obj.alias("object"), load.alias("load_case"))


@query("select load_case as load, count(*) as n, count(*) filter (where candidate like '%prompt\\_ortho%' escape '\\') as fits from candidates where method = 'proposed_max' and seq % 31 <> 0 and load_case in ('bending', 'compression', 'torsion') group by 1", **C1)
def labels_of_load(spark, d):
    """Labels by the plain load case they belong to: those of combined ones, which begin with it, don't count."""
    loads = ("bending", "compression", "torsion")
    own = F.array_compact(F.array(*[F.when(X.belongs_to_load(F.col("candidate"), x), F.lit(x)) for x in loads]))
    c = view(spark, d, CANDIDATES).select("candidate", F.explode(own).alias("load"))
    return c.groupBy("load").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.matches_glob(F.col("candidate"), "*prompt_ortho*")).alias("fits"))


@query("select case method when 'coarse' then 'initial' when 'zz_oracle' then 'oracle' when 'proposed_max' then 'proposed' end as label, count(*) as n from trials group by 1", trials=TRIALS)
def code_labels(spark, d):
    labels = {"coarse": "initial", "zz_oracle": "oracle", "proposed_max": "proposed"}
    return trials(spark, d).groupBy(X.code_label(F.col("method"), labels).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("select view, cast(el as int) as el, cast(az as int) as az, score from views", views=VIEWS)
def view_names(spark, d):
    """Views' lines `name: score` taken apart again."""
    v = views(spark, d)
    line = F.concat(F.lit("view_e"), F.col("el").cast("string"), F.lit("_a"), F.col("az").cast("string"), F.lit(": "), F.col("score").cast("string"))
    key, value = X.labelled_value(F.col("line"))
    el, az = X.view_of_name(F.col("key"))
    return v.select("view", line.alias("line")).select("view", key.alias("key"), value.alias("score")).select("view", el.alias("el"), az.alias("az"), "score")


@query("select o.object, g.v as part, coalesce(cells, '') as cells from (select distinct object from replies) o cross join range(0, 4) g(v) left join (select object, seq % 4 as v, array_to_string(list_sort(list_distinct(flatten(list([seq % 121, seq % 7])))), ',') as cells from replies group by 1, 2) c on c.object = o.object and c.v = g.v", trials=TRIALS, replies=REPLY)
def padded_views(spark, d):
    """The sorted numbers of each of an object's four views; views without a response have none."""
    r = view(spark, d, REPLY).select("object", (F.col("seq") % 4).alias("part"), F.explode(X.block_numbers(F.col("reply"), r"I\.C\.E")).alias("cell")).distinct()
    got = r.groupBy("object", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("cell")), lambda c: c.cast("string")), ",").alias("cells"))
    grid = trials(spark, d).select("object").distinct().select("object", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("part"))
    return grid.join(got, ["object", "part"], "left").fillna("", ["cells"])


@query("select seq, case when seq % 3 = 0 then 2 else 3 end as total, array_to_string(list_sort(list_distinct(case when seq % 3 = 0 then [seq % 121, seq % 7] else [seq % 121, seq % 7, seq % 11] end)), ',') as cells from trials", trials=TRIALS)
def marked_responses(spark, d):
    """Numbers of both kinds of blocks before the summary: how many, and the sorted different ones."""
    head = X.before(F.col("reply"), " SUMMARY ")
    both = F.concat(X.block_numbers(head, r"I\.C\.E"), X.block_numbers(head, r"C\.H"))
    return view(spark, d, MARKED).select("seq", F.size(both).alias("total"), F.array_join(F.transform(F.sort_array(F.array_distinct(both)), lambda c: c.cast("string")), ",").alias("cells"))


@query("select object, cast(sum(case when seq % 3 = 0 then 2 else 3 end) as bigint) as numbers from trials group by 1", trials=TRIALS)
def block_counts(spark, d):
    return view(spark, d, REPLY).groupBy("object").agg(F.sum(X.count_in_blocks(F.col("reply"))).alias("numbers"))


@query("select seq, case when seq % 4 = 0 or seq % 3 = 0 then 2 else 3 end as cells from trials", trials=TRIALS)
def identified_cells(spark, d):
    """Cells that replies name; of some prompts only the first kind counts."""
    return view(spark, d, CELLS).select("seq", X.identified_cells(F.col("reply"), F.col("seq") % 4 == 0).alias("cells"))


BOX = "select unit, cast(floor(x / 50) as bigint) as i, cast(floor(y / 50) as bigint) as j, cast(floor(z / 50) as bigint) as k, count(*) as n, avg(x) as cx, avg(y) as cy, avg(z) as cz from points where val > 100 group by 1, 2, 3, 4"
REL = "select b.*, (cx - mx) / (m + 1e-9) as rx, (cy - my) / (m + 1e-9) as ry, (cz - mz) / (m + 1e-9) as rz from (select box.*, mx, my, mz, greatest(abs(cx - mx), abs(cy - my), abs(cz - mz)) as m, row_number() over (partition by unit order by n desc, i, j, k) as place from box join (select unit, avg(x) as mx, avg(y) as my, avg(z) as mz from points group by 1) using (unit)) b where place <= 3"
WORDS = "case when words = '' then 'center' else words end"


@query(f"select unit, 'High stress gradients at ' || string_agg({WORDS}, ', ' order by place) || '.' as caption from (select *, concat_ws('-', case when rx > 0.15 then 'right' when rx < -0.15 then 'left' end, case when rz > 0.15 then 'front' when rz < -0.15 then 'behind' end, case when ry > 0.15 then 'top' when ry < -0.15 then 'bottom' end) as words from rel) group by 1", **P, box=BOX, rel=REL)
def captions(spark, d):
    """A sentence per unit on where its three fullest hot boxes lie around the middle of all points."""
    p = points(spark, d)
    box = p.where("val > 100").groupBy("unit", *[F.floor(F.col(a) / 50).alias(n) for a, n in zip("xyz", "ijk", strict=True)]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"])
    b = box.join(p.groupBy("unit").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"]), "unit")
    gap = {a: F.col(f"c{a}") - F.col(f"m{a}") for a in "xyz"}
    most = F.greatest(*[F.abs(g) for g in gap.values()]) + 1e-9
    w = Window.partitionBy("unit").orderBy(F.desc("n"), "i", "j", "k")  # some twenty boxes a unit
    top = b.withColumn("place", F.row_number().over(w)).where("place <= 3").select("unit", "place", X.region_words(*[gap[a] / most for a in "xyz"]).alias("words"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "words"))), lambda s: s["words"]), ", ")
    return top.groupBy("unit").agg(F.concat(F.lit("High stress gradients at "), text, F.lit(".")).alias("caption"))
