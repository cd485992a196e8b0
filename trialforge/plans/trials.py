"""Queries over trials: cohorts, leaderboards, paired statistics, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing as X
from ..operators import cohort as C
from ..operators import robust as R
from ..sources.tables import cut
from .registry import query

METHODS = ["coarse", "proposed_max", "heuristic_sub", "mech_sub", "zz_coarse", "zz_oracle"]
LEVELS = [1.0, 1.25, 1.6, 2.0]
UNIT = C.UNIT

TRIALS = """
select cast(user_id as string) as object, user_id,
  case event_type when 'error' then 'bending' when 'click' then 'compression' when 'purchase' then 'torsion'
    when 'view' then 'bending_compression' else 'torsion_compression' end as load_case,
  case event_id % 6 when 0 then 'coarse' when 1 then 'proposed_max' when 2 then 'heuristic_sub' when 3 then 'mech_sub'
    when 4 then 'zz_coarse' else 'zz_oracle' end as method,
  case cast(floor(event_id / 6.0) as bigint) % 4 when 0 then 1.0e0 when 1 then 1.25e0 when 2 then 1.6e0 else 2.0e0 end as h_scale,
  case when event_id % 29 = 0 then null else value / 100 end as vm,
  cast(regexp_extract(props, '([0-9]+)', 1) as double) / 100 as en,
  cast(1000 + 10 * cast(regexp_extract(props, '([0-9]+)', 1) as int) as double) as n_cells,
  case when event_id % 17 = 0 then 'error: solve' when event_id % 13 = 0 then 'ok_norefine' else 'ok' end as status,
  event_id % 3 as source_rank, event_id as seq
from events"""
OK = "select * from trials where status = 'ok'"
SWEPT = "select cast(cast(floor(user_id / 7.0) as bigint) as string) as object, load_case, method, h_scale, vm, en, n_cells, status, source_rank, seq from trials where status in ('ok', 'ok_norefine')"
FIRST = "select * exclude (rn) from (select *, row_number() over (partition by object, load_case, method order by source_rank, seq) as rn from ok) where rn = 1"
V = {"trials": TRIALS, "ok": OK}
F1 = V | {"firsts": FIRST}
S1 = {"trials": TRIALS, "swept": SWEPT}
LIST = "('" + "', '".join(METHODS) + "')"


def trials(spark: SparkSession, d: str) -> DataFrame:
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("__events")
    return spark.sql(TRIALS.replace("from events", "from __events"))


def ok(spark, d) -> DataFrame:
    return C.status_filter(trials(spark, d), "ok")


def firsts(spark, d) -> DataFrame:
    return C.first_by(ok(spark, d), [*UNIT, "method"], ["source_rank", "seq"])


def swept(spark, d) -> DataFrame:
    t = C.status_filter(trials(spark, d), "refined_or_not")
    return t.withColumn("object", F.floor(F.col("user_id") / 7.0).cast("string")).drop("user_id")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("select status, count(*) as n, count(distinct object) as objects from trials where status like 'ok%' group by status", trials=TRIALS)
def status_filter(spark, d):
    return C.status_filter(trials(spark, d), "prefix").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object").alias("objects"))


@query("select object, load_case, method, seq, vm from firsts", **F1)
def dedup_first(spark, d):
    return firsts(spark, d).select(*UNIT, "method", "seq", "vm")


@query("select object, load_case, method, seq, vm from (select *, row_number() over (partition by object, load_case, method order by source_rank desc, seq desc) as rn from ok) where rn = 1", **V)
def dedup_last(spark, d):
    return C.first_by(ok(spark, d), [*UNIT, "method"], ["source_rank", "seq"], last=True).select(*UNIT, "method", "seq", "vm")


COMPLETE = "select object, load_case from firsts group by 1, 2 having count(distinct method) >= 6"


@query("select * from complete", **F1, complete=COMPLETE)
def complete_case(spark, d):
    return C.complete_units(firsts(spark, d), 6)


@query("select object, load_case from firsts where method in ('coarse', 'zz_oracle', 'mech_sub') group by 1, 2 having count(distinct method) = 3", **F1)
def complete_named(spark, d):
    return C.units_with(firsts(spark, d), ["coarse", "zz_oracle", "mech_sub"])


@query("select object from complete group by 1 having count(distinct load_case) = 5", **F1, complete=COMPLETE)
def strict_objects(spark, d):
    return C.strict_objects(C.complete_units(firsts(spark, d), 6), 5)


@query("select method, count(*) as n, count(distinct object) as objects from firsts where object not in (select object from firsts where method = 'zz_oracle' and vm > 3.0) group by 1", **F1)
def oracle_sanity_object(spark, d):
    return C.sane_objects(firsts(spark, d), F.col("method") == "zz_oracle", 3.0).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object").alias("objects"))


@query("select f.object, f.load_case, f.method from firsts f left join (select object, load_case from firsts where method like 'zz%' group by 1, 2 having min(vm) > 0.05) b on f.object = b.object and f.load_case = b.load_case where b.object is null", **F1)
def oracle_sanity_unit(spark, d):
    return C.sane_units(firsts(spark, d), F.col("method").startswith("zz"), 0.05).select(*UNIT, "method")


def board_sql(source: str, keys: str) -> str:
    """A leaderboard by plain window ranks."""
    part = "".join(
        f", t_{v} as (select {keys}, avg({v}) as {v}_trimmed from (select *, row_number() over (partition by {keys} order by {v}) as r, count(*) over (partition by {keys}) as c from {source} where {v} is not null) where r > floor(0.05 * c) and r <= c - floor(0.05 * c) group by {keys})"
        for v in ("vm", "en")
    )
    return part[2:] + f" select {keys}, count(*) as n, round(quantile_cont(vm, 0.5), 6) as vm_median, round(quantile_cont(en, 0.5), 6) as en_median, round(avg(n_cells), 6) as cells_mean, quantile_cont(n_cells, 0.5) as cells_median, round(any_value(vm_trimmed), 6) as vm_trimmed, round(any_value(en_trimmed), 6) as en_trimmed from {source} left join t_vm using ({keys}) left join t_en using ({keys}) group by {keys}"


def board(df: DataFrame, keys: list[str]) -> DataFrame:
    return rounded(R.leaderboard(df, keys), "vm_median", "en_median", "cells_mean", "vm_trimmed", "en_trimmed")


def with_views(sql: str, **views: str) -> str:
    return "with " + ", ".join(f"{k} as ({v})" for k, v in views.items()) + ", " + sql


@query(with_views(board_sql("firsts", "method"), **F1))
def trimmed_leaderboard(spark, d):
    return board(firsts(spark, d), ["method"])


SCOPES = "select 'all' as scope, * from firsts union all select load_case, * from firsts union all select 'bending or torsion', * from firsts where load_case in ('bending', 'torsion')"


@query(with_views(board_sql("scoped", "scope, method"), **F1, scoped=SCOPES))
def scope_leaderboard(spark, d):
    scope = F.array_compact(F.array(F.lit("all"), F.col("load_case"), F.when(F.col("load_case").isin("bending", "torsion"), F.lit("bending or torsion"))))
    return board(firsts(spark, d).withColumn("scope", F.explode(scope)), ["scope", "method"])


TIME = "case when seq % 11 = 0 then null else 10 * en end"  # of a trial, where it was taken
PAIRS = "select a.object, a.load_case, b.method, a.vm - b.vm as d from firsts a join firsts b on a.object = b.object and a.load_case = b.load_case where a.method = 'proposed_max' and b.method <> 'proposed_max' and a.vm is not null and b.vm is not null"
ALL_PAIRS = " union all ".join(f"select '{v}' as metric, b.method, a.{v} - b.{v} as d from firsts a join firsts b on a.object = b.object and a.load_case = b.load_case where a.method = 'proposed_max' and b.method <> 'proposed_max' and a.{v} is not null and b.{v} is not null" for v in ("vm", "en"))


def all_pairs(spark, d) -> DataFrame:
    """(unit, method, metric, d): differences of proposed_max to each other method in both errors. A unit's methods, a handful,
    meet in one aggregate; the trials are read once."""
    of = F.struct("method", "vm", "en")
    f = firsts(spark, d).groupBy(*UNIT).agg(F.max(F.when(F.col("method") == "proposed_max", F.struct("vm", "en"))).alias("own"), F.collect_list(of).alias("of"))
    each = f.where("own is not null").select(*UNIT, "own", F.explode(F.filter("of", lambda x: x["method"] != "proposed_max")).alias("x"))
    diff = F.array(*[F.struct(F.lit(v).alias("metric"), (F.col(f"own.{v}") - F.col(f"x.{v}")).alias("d")) for v in ("vm", "en")])
    return each.select(*UNIT, "x.method", F.inline(diff)).where("d is not null")


def pairs(spark, d, value: str = "vm") -> DataFrame:
    return all_pairs(spark, d).where(F.col("metric") == value).drop("metric")


@query("select metric, method, count(*) as n, round(avg(d), 6) as mean_d, round(case when count(*) > 10 then avg(case when r > floor(0.05 * c) and r <= c - floor(0.05 * c) then d end) else avg(d) end, 6) as trimmed_d, round(quantile_cont(d, 0.5), 6) as median_d, round(avg(case when d < -0.01 then 1.0 else 0.0 end), 6) as win, round(avg(case when d > 0.01 then 1.0 else 0.0 end), 6) as loss, round(avg(case when abs(d) <= 0.01 then 1.0 else 0.0 end), 6) as tie from (select *, row_number() over (partition by metric, method order by d) as r, count(*) over (partition by metric, method) as c from pairs) group by 1, 2", **F1, pairs=ALL_PAIRS)
def paired_stats(spark, d):
    """Of both errors: the trimmed mean of the differences (the plain one of ten or less), their median, how often they win."""
    p = cut(all_pairs(spark, d).select("metric", "method", "d"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    x = F.col("d")
    plain = {"n": F.count(F.lit(1)), "mean_d": F.avg(x), "win": share(x < -0.01), "loss": share(x > 0.01), "tie": share(F.abs(x) <= 0.01)}
    return rounded(R.summary(p, ["metric", "method"], plain, {"median_d": ("d", 0.5)}, {"trimmed_d": ("d", 0.05)}, whole=10), "mean_d", "median_d", "trimmed_d", "win", "loss", "tie")


@query(
    """select method, cast(count(*) as bigint) as n, sum(case when d > 0 then r else 0 end) as w_plus, sum(case when d < 0 then r else 0 end) as w_minus, cast(any_value(tt) as double) as tie_term,
    round((sum(case when d > 0 then r else 0 end) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - any_value(tt) / 48.0), 6) as z
    from (select *, rank() over (partition by method order by abs(d)) + (count(*) over (partition by method, abs(d)) - 1) / 2.0 as r, sum(1) over (partition by method) as nn from pairs where d <> 0)
    join (select method, sum(c * c * c - c) as tt from (select method, abs(d), count(*) as c from pairs where d <> 0 group by 1, 2) group by 1) using (method) group by 1""",
    **F1, pairs=PAIRS,
)
def signed_rank(spark, d):
    return rounded(R.signed_rank(cut(pairs(spark, d).select("method", "d")), ["method"]), "z")


BY_SCOPE = "select 'pooled' as scope, * from swept union all select cast(h_scale as varchar), * from swept"


@query("select scope, t.method, round(t.v, 6) as trimmed, round(100 * (c.v - t.v) / (c.v - o.v + 1e-12), 4) as closed from means t join means c using (scope) join means o using (scope) where t.method not in ('coarse', 'zz_oracle') and c.method = 'coarse' and o.method = 'zz_oracle'", **S1, scoped=BY_SCOPE, means="select scope, method, avg(vm) as v from (select *, row_number() over (partition by scope, method order by vm) as r, count(*) over (partition by scope, method) as c from scoped where vm is not null) where r > floor(0.05 * c) and r <= c - floor(0.05 * c) group by 1, 2")
def gap_closed(spark, d):
    """How much of the gap from the coarse mesh to the oracle each method closes, in percent of trimmed means: pooled and by level."""
    s = swept(spark, d).withColumn("scope", F.explode(F.array(F.lit("pooled"), F.col("h_scale").cast("string"))))
    t = R.trimmed_mean(s, ["scope", "method"], "vm", name="v")
    own = lambda m: F.max(F.when(F.col("method") == m, F.col("v")))
    ends = t.groupBy("scope").agg(own("coarse").alias("c"), own("zz_oracle").alias("o"), F.collect_list(F.struct("method", "v")).alias("of"))  # a handful of methods
    each = ends.select("scope", "c", "o", F.inline("of")).where(~F.col("method").isin("coarse", "zz_oracle"))
    return each.where("c is not null and o is not null").select("scope", "method", F.round("v", 6).alias("trimmed"), F.round(100 * (F.col("c") - F.col("v")) / (F.col("c") - F.col("o") + 1e-12), 4).alias("closed"))


@query("select load_case, count(*) as n, round(avg(a - b), 6) as mean_d from (select object, load_case, avg(case when method like 'zz%' then vm end) as a, avg(case when method like '%_sub' then vm end) as b from ok group by 1, 2) where a is not null and b is not null group by 1", **V)
def backend_mean_paired(spark, d):
    side = ok(spark, d).withColumn("side", F.when(F.col("method").startswith("zz"), "zz").when(F.col("method").endswith("_sub"), "sub"))
    return R.paired(side, UNIT, "side", "zz", "sub", "vm").groupBy("load_case").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean_d"))


@query("select object, load_case, " + ", ".join(f"round(avg(case when method = '{m}' then vm end), 6) as {m}" for m in METHODS) + " from ok group by 1, 2", **V)
def pivot_methods(spark, d):
    return rounded(ok(spark, d).groupBy(*UNIT).pivot("method", METHODS).agg(F.avg("vm")), *METHODS)


@query("select won, method, count(*) as n, round(avg(vm), 6) as mean_vm from firsts join (select object, avg(d) < -0.01 as won from pairs where method = 'heuristic_sub' group by 1) using (object) group by 1, 2", **F1, pairs=PAIRS)
def winner_split(spark, d):
    won = pairs(spark, d).where("method = 'heuristic_sub'").groupBy("object").agg((F.avg("d") < -0.01).alias("won"))
    return firsts(spark, d).join(won, "object").groupBy("won", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("vm"), 6).alias("mean_vm"))


TIMED = f"select object, load_case from firsts where {TIME} is not null group by 1, 2 having count(distinct method) = 6"


@query(f"select method, n, median_vm, median_cells, coalesce(n_timed, 0) as n_timed, median_time from (select method, count(*) as n, round(quantile_cont(vm, 0.5), 6) as median_vm, quantile_cont(n_cells, 0.5) as median_cells from firsts group by 1) left join (select method, count(*) as n_timed, round(quantile_cont({TIME}, 0.5), 6) as median_time from firsts join timed using (object, load_case) group by 1) using (method)", **F1, timed=TIMED)
def cost_table(spark, d):
    """Figures of all trials of a method, but times only of units that are timed for all methods."""
    f = cut(firsts(spark, d).select(*UNIT, "method", "vm", "n_cells", F.expr(TIME).alias("t")))
    timed = C.complete_units(f.where("t is not null"), len(METHODS)).withColumn("timed", F.lit(True))
    f = f.join(timed, UNIT, "left").withColumn("t", F.when(F.col("timed"), F.col("t")))
    s = R.summary(cut(f), ["method"], {"n": F.count(F.lit(1)), "n_timed": F.count("t")}, {"median_vm": ("vm", 0.5), "median_cells": ("n_cells", 0.5), "median_time": ("t", 0.5)})
    return rounded(s, "median_vm", "median_time")


@query("select method, cast(count(*) as bigint) as n, round(corr(rx, ry), 6) as rho from (select method, rank() over (partition by method order by vm) + (count(*) over (partition by method, vm) - 1) / 2.0 as rx, rank() over (partition by method order by n_cells) + (count(*) over (partition by method, n_cells) - 1) / 2.0 as ry from firsts where vm is not null and n_cells is not null) group by 1", **F1)
def spearman_within_method(spark, d):
    return rounded(R.spearman(firsts(spark, d), ["method"], "vm", "n_cells"), "rho")


@query("select object, load_case, round(coalesce(avg(case when method like 'zz%' then n_cells end), avg(n_cells)), 6) as target from ok group by 1, 2", **V)
def budget_target(spark, d):
    return ok(spark, d).groupBy(*UNIT).agg(F.round(F.coalesce(F.avg(F.when(F.col("method").startswith("zz"), F.col("n_cells"))), F.avg("n_cells")), 6).alias("target"))


@query("select f.object, f.load_case, f.method, q.qoi, round(abs(case q.qoi when 'vm' then f.vm - r.vm when 'en' then f.en - r.en else f.n_cells - r.n_cells end) / (abs(case q.qoi when 'vm' then r.vm when 'en' then r.en else r.n_cells end) + 1e-30), 6) as rel from firsts f join firsts r on f.object = r.object and f.load_case = r.load_case and r.method = 'zz_oracle' cross join (values ('vm'), ('en'), ('n_cells')) q(qoi) where f.method <> 'zz_oracle'", **F1)
def relative_error(spark, d):
    f = firsts(spark, d)
    names = ["vm", "en", "n_cells"]
    ref = f.where("method = 'zz_oracle'").select(*UNIT, *[F.col(n).alias(f"ref_{n}") for n in names])
    j = f.where("method <> 'zz_oracle'").join(ref, UNIT)
    rel = F.explode(F.array(*[F.struct(F.lit(n).alias("qoi"), F.round(F.abs(F.col(n) - F.col(f"ref_{n}")) / (F.abs(F.col(f"ref_{n}")) + 1e-30), 6).alias("rel")) for n in names]))
    return j.select(*UNIT, "method", rel.alias("x")).select(*UNIT, "method", "x.qoi", "x.rel")


@query("select object, load_case, method, seq, case when status = 'ok' and n_cells <= 1.05 * max(case when method = 'coarse' then n_cells end) over (partition by object, load_case) and method <> 'coarse' then 'ok_norefine' else status end as status from trials", trials=TRIALS)
def norefine_flag(spark, d):
    coarse = F.max(F.when(F.col("method") == "coarse", F.col("n_cells"))).over(Window.partitionBy(*UNIT))
    flat = (F.col("status") == "ok") & (F.col("n_cells") <= 1.05 * coarse) & (F.col("method") != "coarse")
    return trials(spark, d).select(*UNIT, "method", "seq", F.when(flat, "ok_norefine").otherwise(F.col("status")).alias("status"))


GRID = "select object, load_case, method, h_scale from (select distinct object from trials) cross join (select distinct load_case from trials) cross join (select distinct method from trials) cross join (select distinct h_scale from trials)"


@query("select g.*, row_number() over (partition by object order by h_scale, load_case, method) as place from (select * from grid except select object, load_case, method, h_scale from ok) g", **V, grid=GRID)
def pending_work(spark, d):
    """What isn't done yet of all methods at all levels, each object's heaviest (finest) work first."""
    t = trials(spark, d)
    # the names of load cases, methods and levels are fixed; objects are the only side that grows
    names = {"load_case": X.LOADS, "method": METHODS, "h_scale": LEVELS}
    grid = t.select("object").distinct()
    for c, values in names.items():
        grid = grid.withColumn(c, F.explode(F.array(*[F.lit(v) for v in values])))
    left = grid.join(C.status_filter(t).select(*UNIT, "method", "h_scale").distinct(), [*UNIT, "method", "h_scale"], "left_anti")
    # at most one row for each load case, method and level in a window
    return left.withColumn("place", F.row_number().over(Window.partitionBy("object").orderBy("h_scale", "load_case", "method")).cast("long"))


@query("select distinct object, load_case, method, h from (select object, load_case, method, unnest(case when method = 'coarse' then [1.0e0, 1.25e0, 1.6e0, 2.0e0] else [h_scale] end) as h from ok)", **V)
def done_manifest(spark, d):
    levels = F.when(F.col("method") == "coarse", F.array(*[F.lit(x) for x in LEVELS])).otherwise(F.array("h_scale"))
    return ok(spark, d).select(*UNIT, "method", F.explode(levels).alias("h")).distinct()


@query("select object, load_case, coalesce(min(case when source_rank = 0 then vm end), min(case when source_rank = 1 then vm end), min(case when source_rank = 2 then vm end)) as vm from trials where vm is not null group by 1, 2", trials=TRIALS)
def first_non_null(spark, d):
    t = trials(spark, d)
    return C.first_non_null([t.where(F.col("source_rank") == i) for i in range(3)], UNIT, "vm")


ALL_LEVELS = f"select object, load_case from swept where method in {LIST} group by 1, 2 having count(distinct method || '|' || cast(h_scale as varchar)) = 24"


@query("select * from complete", **S1, complete=ALL_LEVELS)
def all_levels_complete(spark, d):
    return C.units_at_all_levels(swept(spark, d), METHODS, LEVELS)


@query("select object, count(*) as units from (" + " intersect ".join(f"select object, load_case from swept where h_scale = {h} group by 1, 2 having count(distinct method) >= 6" for h in LEVELS) + ") group by 1 having count(distinct load_case) = 5", **S1)
def strict_intersection(spark, d):
    s, units = swept(spark, d), None
    for h in LEVELS:
        part = C.complete_units(s.where(F.col("h_scale") == h), 6)
        units = part if units is None else units.intersect(part)
    return units.groupBy("object").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("load_case").alias("n")).where("n = 5").drop("n")


KEPT = "select s.* from swept s join complete using (object, load_case)"
PARETO = f"select h_scale, method, count(*) as n, avg(vm) as vm_mean, quantile_cont(vm, 0.5) as vm_med, avg(en) as energy_mean, quantile_cont(en, 0.5) as energy_med, avg(n_cells) as cells, quantile_cont(n_cells, 0.5) as cells_med, quantile_cont({TIME}, 0.5) as t_med from kept group by 1, 2"
TRIMS = ", ".join(f"t_{v} as (select h_scale, method, avg({v}) as {n}_tmean from (select *, row_number() over (partition by h_scale, method order by {v}) as r, count(*) over (partition by h_scale, method) as c from kept where {v} is not null) where r > floor(0.05 * c) and r <= c - floor(0.05 * c) group by 1, 2)" for v, n in (("vm", "vm"), ("en", "energy")))


@query(with_views(TRIMS + " select h_scale, method, n, " + ", ".join(f"round({c}, 6) as {c}" for c in ("vm_mean", "vm_tmean", "vm_med", "energy_mean", "energy_tmean", "energy_med", "cells", "cells_med", "t_med")) + " from (select unnest([1.0e0, 1.25e0, 1.6e0, 2.0e0]) as h_scale) cross join (select unnest(" + str(METHODS) + ") as method) left join pareto using (h_scale, method) left join t_vm using (h_scale, method) left join t_en using (h_scale, method)", **S1, complete=ALL_LEVELS, kept=KEPT, pareto=PARETO))
def pareto_agg(spark, d):
    """Errors, cells, times and trimmed means by level and method, over units that are complete; a row for each pair of the grid."""
    s = cut(swept(spark, d).select(*UNIT, "method", "h_scale", "vm", "en", "n_cells", "seq"))
    kept = cut(C.keep_units(s, C.units_at_all_levels(s, METHODS, LEVELS)).select("h_scale", "method", "vm", "en", "n_cells", F.expr(TIME).alias("t")))
    plain = {"n": F.count(F.lit(1)), "vm_mean": F.avg("vm"), "energy_mean": F.avg("en"), "cells": F.avg("n_cells")}
    t = R.summary(kept, ["h_scale", "method"], plain, {"vm_med": ("vm", 0.5), "energy_med": ("en", 0.5), "cells_med": ("n_cells", 0.5), "t_med": ("t", 0.5)}, {"vm_tmean": ("vm", 0.05), "energy_tmean": ("en", 0.05)})
    grid = spark.createDataFrame([(h, m) for h in LEVELS for m in METHODS], "h_scale double, method string")
    return rounded(grid.join(t, ["h_scale", "method"], "left"), *[c for c in t.columns if c not in ("h_scale", "method", "n")])


@query("select method, round(avg(case when h_scale = 2.0 then vm end) - avg(case when h_scale = 1.0 then vm end), 6) as delta, round(100.0 * (greatest(" + ", ".join(f"avg(case when h_scale = {h} then n_cells end)" for h in LEVELS) + ") / least(" + ", ".join(f"avg(case when h_scale = {h} then n_cells end)" for h in LEVELS) + ") - 1), 4) as spread from swept group by 1", **S1)
def sweep_deltas(spark, d):
    at = lambda v, h: F.avg(F.when(F.col("h_scale") == h, F.col(v)))
    cells = [at("n_cells", h) for h in LEVELS]
    return swept(spark, d).groupBy("method").agg(F.round(at("vm", 2.0) - at("vm", 1.0), 6).alias("delta"), F.round(100.0 * (F.greatest(*cells) / F.least(*cells) - 1), 4).alias("spread"))


@query("select h_scale, string_agg(method, '>' order by m, method) as ranking from (select h_scale, method, avg(vm) as m from swept group by 1, 2) group by 1", **S1)
def rank_stability(spark, d):
    m = swept(spark, d).groupBy("h_scale", "method").agg(F.avg("vm").alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("m", "method")))
    return m.groupBy("h_scale").agg(F.array_join(F.transform(ordered, lambda x: x["method"]), ">").alias("ranking"))


TRIMMED = {v: "select dim, level, avg(v) as m from (select *, row_number() over (partition by dim, level order by v) as r, count(*) over (partition by dim, level) as c from (" + " union all ".join(f"select '{c}' as dim, cast({c} as varchar) as level, {v} as v from swept where {v} is not null" for c in ("load_case", "method", "h_scale")) + ")) where r > floor(0.05 * c) and r <= c - floor(0.05 * c) group by 1, 2" for v in ("vm", "en")}


@query("select dim, levels, vm_sd, vm_range, en_sd, en_range from (select dim, count(*) as levels, round(stddev_pop(m), 6) as vm_sd, round(max(m) - min(m), 6) as vm_range from t_vm group by 1) join (select dim, round(stddev_pop(m), 6) as en_sd, round(max(m) - min(m), 6) as en_range from t_en group by 1) using (dim)", **S1, t_vm=TRIMMED["vm"], t_en=TRIMMED["en"])
def dimension_sensitivity(spark, d):
    """How far the trimmed means of the levels of each dimension lie apart."""
    dims = ["load_case", "method", "h_scale"]
    flat = swept(spark, d).select("vm", "en", F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("level")) for c in dims])).alias("x")).select("x.dim", "x.level", "vm", "en")
    t = R.summary(flat, ["dim", "level"], {}, {}, {"vm": ("vm", 0.05), "en": ("en", 0.05)})
    return t.groupBy("dim").agg(F.count(F.lit(1)).alias("levels"), *[x for v in ("vm", "en") for x in (F.round(F.stddev_pop(v), 6).alias(f"{v}_sd"), F.round(F.max(v) - F.min(v), 6).alias(f"{v}_range"))])


@query("select dim, level, round(tm, 6) as trimmed from (" + " union all ".join(f"select '{c}' as dim, k as level, avg(vm) as tm from (select cast({c} as varchar) as k, vm, row_number() over (partition by {c} order by vm) as r, count(*) over (partition by {c}) as c from swept where vm is not null) where r > floor(0.05 * c) and r <= c - floor(0.05 * c) group by k" for c in ("load_case", "method")) + ")", **S1)
def trimmed_by_dimension(spark, d):
    flat = swept(spark, d).select("vm", F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("level")) for c in ("load_case", "method")])).alias("x")).select("x.dim", "x.level", "vm")
    return rounded(R.trimmed_mean(flat, ["dim", "level"], "vm"), "trimmed")


@query("select method from swept group by 1 having count(distinct load_case || '|' || cast(h_scale as varchar)) = (select count(distinct load_case || '|' || cast(h_scale as varchar)) from swept)", **S1)
def method_coverage(spark, d):
    s = swept(spark, d)
    pair = F.struct("load_case", "h_scale")
    need = s.agg(F.count_distinct(pair).alias("need"))
    return s.groupBy("method").agg(F.count_distinct(pair).alias("n")).join(F.broadcast(need), F.col("n") == F.col("need")).select("method")


BIG = "select l_partkey as object, l_returnflag || l_linestatus as load_case, l_linenumber as method, l_extendedprice / 100000.0 as vm, l_discount as en, l_quantity as n_cells from lineitem"


def big(spark, d) -> DataFrame:
    c = F.col
    return spark.read.parquet(f"{d}/lineitem.parquet").select(c("l_partkey").alias("object"), F.concat("l_returnflag", "l_linestatus").alias("load_case"), c("l_linenumber").alias("method"), (c("l_extendedprice") / 100000.0).cast("double").alias("vm"), c("l_discount").cast("double").alias("en"), c("l_quantity").cast("double").alias("n_cells"))


@query("select object, load_case from big group by 1, 2 having count(distinct method) >= 3", big=BIG)
def big_complete_case(spark, d):
    return C.complete_units(big(spark, d), 3)


@query("select method, count(*) as n, round(avg(vm), 5) as mean_vm, round(quantile_cont(cast(vm as double), 0.5), 5) as median_vm, round(sum(case when r > floor(0.05 * c) and r <= c - floor(0.05 * c) then vm end) / sum(case when r > floor(0.05 * c) and r <= c - floor(0.05 * c) then 1 end), 5) as trimmed from (select *, row_number() over (partition by method order by vm) as r, count(*) over (partition by method) as c from big) group by 1", big=BIG)
def big_leaderboard(spark, d):
    b = big(spark, d)
    plain = b.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("vm").alias("mean_vm"))
    return rounded(plain.join(R.quantiles(b, ["method"], "vm", {"median_vm": 0.5}, {"trimmed": 0.05}), "method"), "mean_vm", "median_vm", "trimmed", digits=5)


@query("select load_case, " + ", ".join(f"round(avg(case when method = {m} then vm end), 6) as m{m}" for m in range(1, 8)) + " from big group by 1", big=BIG)
def big_pivot(spark, d):
    p = big(spark, d).groupBy("load_case").pivot("method", list(range(1, 8))).agg(F.avg("vm"))
    return p.select("load_case", *[F.round(F.col(str(m)), 6).alias(f"m{m}") for m in range(1, 8)])


@query("select n_name as stratum, p_brand as brand, count(*) as n, cast(sum(l_quantity) as double) as quantity from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2")
def lookup_labels(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    # part and supplier grow with the data: Spark picks the join by their sizes; nation is fixed
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("stratum"), F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("select object, load_case, method, seq from (select *, row_number() over (partition by object, load_case order by md5('7|' || cast(seq as varchar)), seq) as r from ok) where r <= 3", **V)
def subsample_matched(spark, d):
    w = Window.partitionBy(*UNIT).orderBy(F.md5(F.concat(F.lit("7|"), F.col("seq").cast("string")).cast("binary")), "seq")
    return ok(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select(*UNIT, "method", "seq")


@query("select object, case when ('x' || substr(md5(object), 1, 4)) < 'x1000' then 'val' else 'train' end as split, count(*) as n from trials group by 1, 2", trials=TRIALS)
def group_split(spark, d):
    split = F.when(F.substring(F.md5(F.col("object").cast("binary")), 1, 4) < "1000", "val").otherwise("train")
    return trials(spark, d).groupBy("object", split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("select shard, count(*) as n, min(object) as first from (select object, load_case, (row_number() over (partition by load_case order by object) - 1) % 8 as shard from (select distinct object, load_case from trials)) group by 1", trials=TRIALS)
def modulo_shards(spark, d):
    """Every eighth unit of a load case in one shard, by the ranks of the units."""
    units = trials(spark, d).select(*UNIT).distinct()
    ranked = R.range_ranks(units, ["load_case"], "object")
    return ranked.groupBy((F.col("rank") % 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("object").alias("first"))


@query("select f.object, f.load_case, f.seq from (select *, row_number() over (partition by object, load_case order by md5('3|' || cast(seq as varchar)), seq) as r from ok where method = 'heuristic_sub') f join (select object, load_case, count(*) as n from ok where method = 'proposed_max' group by 1, 2) c using (object, load_case) where r <= n", **V)
def subsample_to_other(spark, d):
    """Of each unit as many rows of one method as another has there, in random order that doesn't change; all where these are fewer."""
    o = ok(spark, d)
    n = o.where("method = 'proposed_max'").groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*UNIT).orderBy(F.md5(F.concat(F.lit("3|"), F.col("seq").cast("string")).cast("binary")), "seq")
    own = o.where("method = 'heuristic_sub'").join(n, UNIT).withColumn("r", F.row_number().over(w))
    return own.where("r <= n").select(*UNIT, "seq")


@query("select object from (select distinct object from trials except select object from complete) order by md5(object) limit 20", **F1, complete=COMPLETE)
def sample_unseen(spark, d):
    fresh = trials(spark, d).select("object").distinct().join(C.complete_units(firsts(spark, d), 6).select("object").distinct(), "object", "left_anti")
    return fresh.orderBy(F.md5(F.col("object").cast("binary"))).limit(20)


@query("select object, load_case, rank, method from (select object, load_case, method, row_number() over (partition by object, load_case order by vm desc, method) as rank from firsts where vm is not null) where rank <= 3", **F1)
def topn_per_unit(spark, d):
    w = Window.partitionBy(*UNIT).orderBy(F.desc("vm"), "method")
    return firsts(spark, d).where("vm is not null").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select(*UNIT, "rank", "method")


@query("select method, h_scale, grouping(method) + grouping(h_scale) as depth, count(*) as n, round(avg(vm), 6) as mean_vm from ok group by grouping sets ((method, h_scale), (method), ())", **V)
def pooled_scopes(spark, d):
    g = ok(spark, d).groupingSets([["method", "h_scale"], ["method"], []], "method", "h_scale")
    return g.agg((F.grouping("method") + F.grouping("h_scale")).cast("long").alias("depth"), F.count(F.lit(1)).alias("n"), F.round(F.avg("vm"), 6).alias("mean_vm"))


@query("select method, round(quantile_cont(n_cells, 0.5), 6) as median_cells, round(quantile_cont(n_cells / m, 0.5), 6) as median_share from (select *, max(n_cells) over (partition by object, load_case) as m from firsts) group by 1", **F1)
def concentration(spark, d):
    top = F.max("n_cells").over(Window.partitionBy(*UNIT))
    f = firsts(spark, d).withColumn("share", F.col("n_cells") / top)
    return rounded(R.summary(f, ["method"], {}, {"median_cells": ("n_cells", 0.5), "median_share": ("share", 0.5)}), "median_cells", "median_share")


@query("select min(n_cells) / 1.25 as least, max(n_cells) * 1.25 as most, ceil(max(n) * 1.5) as budget, round(quantile_cont(n_cells, 0.5), 6) as middle, o.method from ok o join (select method, max(n) as n from (select method, object, count(*) as n from ok group by 1, 2) group by 1) m on m.method = o.method group by o.method", **V)
def sizing_bounds(spark, d):
    """Limits of sizes with a margin, their middle, and the room for the largest number of rows of an object."""
    o = ok(spark, d)
    most = o.groupBy("method", "object").agg(F.count(F.lit(1)).alias("n")).groupBy("method").agg(F.ceil(F.max("n") * 1.5).cast("double").alias("budget"))
    s = R.summary(o, ["method"], {"least": F.min("n_cells") / 1.25, "most": F.max("n_cells") * 1.25}, {"middle": ("n_cells", 0.5)})
    return rounded(s.join(most, "method"), "middle")


@query("select h_scale, method, round(m, 6) as mean_vm, m - min(m) over (partition by h_scale) < 5e-4 as best from (select h_scale, method, avg(vm) as m from ok group by 1, 2)", **V)
def best_in_column(spark, d):
    m = ok(spark, d).groupBy("h_scale", "method").agg(F.avg("vm").alias("m"))
    return m.select("h_scale", "method", F.round("m", 6).alias("mean_vm"), (F.col("m") - F.min("m").over(Window.partitionBy("h_scale")) < 5e-4).alias("best"))
