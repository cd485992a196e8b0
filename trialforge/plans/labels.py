"""Queries over labels, logs and responses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as X
from ..sources.tables import new_folder
from .registry import query
from .trials import TRIALS, trials

CANDIDATES = """select *, 'refined_mesh/' || candidate || case when h_scale = 1.0 then '' when h_scale = 2.0 then '_hs2' else '_hs' || cast(h_scale as varchar) end || case when seq % 2 = 0 then '_fine2_mesh' else '' end || '_refined.msh' as candidate_msh from (
  select *, case when seq % 31 = 0 then 'unknown_label' when method = 'proposed_max' then load_case || '_gemini-3_geo_' || case seq % 5 when 0 then 'mid' when 1 then 'none' else 'max' end || 'prompt_ortho_5views_11grid_1run'
    when method = 'heuristic_sub' then 'heuristic_baseline_DENSE_dihedral30.0deg_sub' when method = 'mech_sub' then 'heuristic_mech_dihedral30.0deg_' || load_case || '_sub' else method end as candidate from trials)"""
C1 = {"trials": TRIALS, "candidates": CANDIDATES}
LOGS = """select seq, seq % 8 as worker, case when seq % 5 = 0 then 'noise ' || object when seq % 5 = 1 then '[DONE] ' || object when seq % 5 = 2 and seq % 8 = 7 then '[' || cast(seq % 97 as varchar) || '/120] OBJECT ' || object when seq % 5 = 2 then '[progress] ' || cast(seq % 97 as varchar) || '/97 objects done'
  else '[SUCCESS] ' || object || ' | ' || load_case || '_gemini-3_geo_maxprompt_ortho_' || cast(1 + seq % 7 as varchar) || 'views_11grid_1run | Result: {''coarse'': {''rel_L2'': ' || cast(seq % 100 as varchar) || '.5, ''rel_energy'': ' || cast(seq % 10 as varchar) || '.25}, ''refined'': {''rel_L2'': ' || cast(seq % 50 as varchar) || '.5, ''rel_energy'': 0.5}}' end as line from trials"""
L1 = {"trials": TRIALS, "logs": LOGS}
REPLY = "select seq, object, 'intro ***I.C.E: ' || cast(seq % 121 as varchar) || ', x, ' || cast(seq % 7 as varchar) || '*** then ***C.H: ' || case when seq % 3 = 0 then 'NONE' else cast(seq % 11 as varchar) end || '***' as reply from trials"
R1 = {"trials": TRIALS, "replies": REPLY}


def view(spark, d, sql: str) -> DataFrame:
    """A view's rows; these make input text, so the same SQL serves both engines."""
    trials(spark, d).createOrReplaceTempView("__trials")
    return spark.sql(re.sub(r"''(\w+)''", r"\'\1\'", sql.replace("from trials", "from __trials")).replace("varchar", "string"))


@query("select seq, case when candidate in ('coarse', 'zz_coarse', 'zz_oracle') then candidate when candidate like 'heuristic_baseline_DENSE_%_sub' then 'heuristic_sub' when candidate like 'heuristic_mech_%_sub' then 'mech_sub' when candidate like load_case || '\\_gemini%\\_geo\\_%prompt\\_ortho\\_5views%' escape '\\' then 'proposed_' || regexp_extract(candidate, '_geo_([a-z]+)prompt', 1) end as family from candidates", **C1)
def canonical_method(spark, d):
    c = view(spark, d, CANDIDATES)
    return c.select("seq", X.method_of(F.col("candidate"), F.col("load_case")).alias("family"))


@query("select h_scale as level, count(*) as n from candidates group by 1", **C1)
def level_from_name(spark, d):
    return view(spark, d, CANDIDATES).groupBy(X.level_of_name(F.col("candidate_msh")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("select seq, case when contains(candidate, 'gemini') then 'gemini' when contains(candidate, 'mech') then 'mech' when contains(candidate, 'heuristic') then 'blind' end as backend, regexp_replace(candidate, '_[0-9]+run$', '') as family from candidates", **C1)
def backend_labels(spark, d):
    table = [("gemini", "gemini"), ("mech", "mech"), ("heuristic", "blind")]
    return view(spark, d, CANDIDATES).select("seq", X.first_label(F.col("candidate"), table).alias("backend"), F.regexp_replace("candidate", r"_\d+run$", "").alias("family"))


@query("select load_case, parts[1] || '_' || parts[2] as model, replace(parts[3], 'prompt', '') as prompt, parts[4] as view_type, cast(replace(parts[5], 'views', '') as int) as k, cast(replace(parts[6], 'grid', '') as int) as grid, count(*) as n from (select load_case, string_split(substr(candidate, length(load_case) + 2), '_') as parts from candidates where candidate like '%1run') group by all", **C1)
def parse_experiment(spark, d):
    c = view(spark, d, CANDIDATES).withColumns({f"p_{k}": v for k, v in X.experiment_parts(F.col("candidate")).items()}).where("p_load_case <> ''")
    return c.groupBy(*[F.col(f"p_{k}").alias(k) for k in ("load_case", "model", "prompt", "view_type")], F.col("p_k").cast("int").alias("k"), F.col("p_grid").cast("int").alias("grid")).agg(F.count(F.lit(1)).alias("n"))


@query("select object, load_case || '_gemini-3_geo_maxprompt_ortho_' || cast(1 + seq % 7 as varchar) || 'views_11grid_1run' as experiment, seq % 100 + 0.5 as coarse, round((seq % 50 + 0.5) / (seq % 100 + 0.5), 6) as ratio from trials where seq % 5 > 2", **L1)
def parse_success_log(spark, d):
    lines = view(spark, d, LOGS).where(F.col("line").startswith("[SUCCESS] "))
    obj, exp, res = X.success_parts(F.col("line"))
    return lines.select(obj.alias("object"), exp.alias("experiment"), res.alias("res")).select("object", "experiment", F.col("res.coarse.rel_L2").alias("coarse"), F.round(X.guarded_ratio(F.col("res.refined.rel_L2"), F.col("res.coarse.rel_L2")), 6).alias("ratio"))


@query("select distinct object as id, 'DONE' as status from trials where seq % 5 = 1", **L1)
def status_ids(spark, d):
    pattern = r"^\[(DONE|SKIP|TIMEOUT|ERROR)\] (\S+)"
    lines = view(spark, d, LOGS).where(F.col("line").rlike(pattern))
    return lines.select(F.regexp_extract("line", pattern, 2).alias("id"), F.regexp_extract("line", pattern, 1).alias("status")).distinct()


OLD_NAMES = "select seq, 'part_' || object || '_' || case when seq % 3 = 0 then 'random' else 'ortho' end || '_' || cast(1 + seq % 7 as varchar) || 'views_gemini-3_' || cast(5 + seq % 9 as varchar) || 'grid_' || cast(seq % 4 as varchar) || 'neighbours_' || cast(1 + seq % 5 as varchar) || 'run' as name from trials"


@query("select view_type, k, model, grid, neighbours, run, count(*) as n, count(distinct mesh) as meshes from (select case when contains(name, '_ortho_') then 'ortho' else 'random' end as view_type, split_part(regexp_replace(name, '_(ortho|random)_', '#'), '#', 1) as mesh, cast(split_part(split_part(regexp_replace(name, '_(ortho|random)_', '#'), '#', 2), 'views_', 1) as int) as k, split_part(split_part(name, 'views_', 2), '_', 1) as model, cast(split_part(split_part(name, 'grid_', 1), '_', -1) as int) as grid, cast(split_part(split_part(name, 'grid_', 2), 'neighbours', 1) as int) as neighbours, cast(split_part(split_part(name, 'neighbours_', 2), 'run', 1) as int) as run from names) group by all", trials=TRIALS, names=OLD_NAMES)
def parse_old_experiment(spark, d):
    p = view(spark, d, OLD_NAMES).select(*[v.alias(k) for k, v in X.old_experiment_parts(F.col("name")).items()]).where("mesh <> ''")
    number = lambda c: F.col(c).cast("int").alias(c)
    return p.groupBy("view_type", number("k"), "model", number("grid"), number("neighbours"), number("run")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mesh").alias("meshes"))


TASKS = "select distinct object, load_case || '_gemini-3_geo_maxprompt_ortho_' || cast(1 + seq % 7 as varchar) || 'views_11grid_1run' as experiment from trials"


@query("select object, experiment from tasks except select object, load_case || '_gemini-3_geo_maxprompt_ortho_' || cast(1 + seq % 7 as varchar) || 'views_11grid_1run' from trials where seq % 5 > 2", **L1, tasks=TASKS)
def pending_from_logs(spark, d):
    """Tasks, as pairs of object and experiment, that no success line of the workers' log files names."""
    at = new_folder(spark, "logs")
    view(spark, d, LOGS).select("worker", "line").write.partitionBy("worker").text(at)
    obj, exp = X.success_pair(F.col("line"))
    done = spark.read.text(at).select(F.col("value").alias("line")).select(obj.alias("object"), exp.alias("experiment")).where("object is not null").distinct()
    return view(spark, d, TASKS).join(done, ["object", "experiment"], "left_anti")


WORKERS = "select worker, coalesce(max_by(try_cast(regexp_extract(line, '([0-9]+)/', 1) as int), seq) filter (where line like '[progress]%'), 0) as done, coalesce(max_by(try_cast(regexp_extract(line, '/([0-9]+)', 1) as int), seq) filter (where line like '[progress]%'), max_by(try_cast(regexp_extract(line, '/([0-9]+)', 1) as int), seq) filter (where line like '%] OBJECT %'), 0) as total from logs group by 1"


def workers(spark, d) -> DataFrame:
    """(worker, done, total): the last progress line of each; one without any has done nothing of what its last header says."""
    line, seq = F.col("line"), F.col("seq")

    def last(pattern: str, i: int):
        return F.max_by(F.regexp_extract(line, pattern, i).cast("int"), F.when(line.rlike(pattern), seq))

    progress, header, zero = r"^\[progress\] ([0-9]+)/([0-9]+)", r"^\[([0-9]+)/([0-9]+)\] OBJECT", F.lit(0)
    return view(spark, d, LOGS).groupBy("worker").agg(F.coalesce(last(progress, 1), zero).alias("done"), F.coalesce(last(progress, 2), last(header, 2), zero).alias("total"))


@query("select * from workers", **L1, workers=WORKERS)
def progress_by_worker(spark, d):
    return workers(spark, d)


@query("select cast(sum(done) as bigint) as done, cast(sum(total) as bigint) as total, round(100.0 * sum(done) / sum(total), 6) as percent, round(sum(done) / 2.5, 6) as an_hour, round(3600 * (sum(total) - sum(done)) / (sum(done) / 2.5), 3) as seconds_left from workers", **L1, workers=WORKERS)
def progress_total(spark, d, hours: float = 2.5):
    """How much all workers have done together in `hours`, how fast they are and how long the rest takes; null without any."""
    done, total = F.sum("done"), F.sum("total")
    rate = F.when(done > 0, done / hours)
    return workers(spark, d).agg(done.alias("done"), total.alias("total"), F.round(100.0 * done / total, 6).alias("percent"), F.round(rate, 6).alias("an_hour"), F.round(3600 * (total - done) / rate, 3).alias("seconds_left"))


@query("select seq, array_to_string([cast(seq % 121 as varchar), cast(seq % 7 as varchar)], ',') as ice, case when seq % 3 = 0 then '' else cast(seq % 11 as varchar) end as ch, (case when seq % 3 = 0 then 2 else 3 end) as total from replies", **R1)
def response_cells(spark, d):
    ice, ch = X.block_numbers(F.col("reply"), r"I\.C\.E"), X.block_numbers(F.col("reply"), r"C\.H")
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return view(spark, d, REPLY).select("seq", text(ice).alias("ice"), text(ch).alias("ch"), (F.size(ice) + F.size(ch)).alias("total"))


@query("select object, round(avg(case when seq % 3 = 0 then 2 else 3 end), 6) as per_view from replies group by 1", **R1)
def cells_per_view(spark, d):
    n = F.size(X.block_numbers(F.col("reply"), r"I\.C\.E")) + F.size(X.block_numbers(F.col("reply"), r"C\.H"))
    return view(spark, d, REPLY).groupBy("object").agg(F.round(F.avg(n), 6).alias("per_view"))


@query("select name, n from (select l.load_case || '_gemini_' || p || 'prompt_ortho_' || cast(k as varchar) || 'views_11grid_1run' as name, l.load_case as lc, p, k from (select distinct load_case from trials) l cross join (values ('max'), ('mid'), ('none')) t(p) cross join range(1, 11) r(k)) left join (select load_case as lc, 1 + seq % 7 as k, count(*) as n from trials group by 1, 2) using (lc, k)", trials=TRIALS)
def experiment_grid(spark, d):
    """All experiments of the grid with the number of their rows, null where there is none."""
    t = trials(spark, d)
    dims = t.select("load_case").distinct().select("load_case", F.explode(F.array(*[F.lit(p) for p in ("max", "mid", "none")])).alias("p")).select("load_case", "p", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"))
    got = t.groupBy("load_case", (1 + F.col("seq") % 7).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(1)
    name = X.experiment_name(F.col("load_case"), F.lit("gemini"), F.col("p"), F.lit("ortho"), F.col("k"), F.lit(11), one)
    return dims.join(got, ["load_case", "k"], "left").select(name.alias("name"), "n")


@query("select doc_id, len(regexp_extract_all(text, '[0-9]+')) as numbers from documents")
def digits_in_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("numbers"))
