"""Column functions over names, lines and responses, by cases."""

from pyspark.sql import functions as F

from trialforge.functions import parsing as X
from trialforge.operators import cohort as C
from trialforge.operators import spatial as S


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r) for r in rows.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").drop("i").collect()]


def test_names(spark):
    t = F.col("t")
    assert values(spark, ["a_amberf_h125", "a_amberfd_h999", "a_h125", None], *X.suffix_codes(t)) == [("fine", 1.25), ("dense", None), (None, None), (None, None)]
    assert values(spark, ["00_1_bending_compression", "x_torsion", "bending", ""], *X.object_and_load(t)) == [("00_1", "bending_compression"), ("x", "torsion"), ("", ""), ("", "")]
    assert values(spark, ["bending_gemini", "bending_compression_gemini", "bending", "bendings_a"], X.belongs_to_load(t, "bending")) == [(True,), (False,), (True,), (False,)]
    assert values(spark, ["a_5views", "a_5view", "b+c_5views"], X.matches_glob(t, "*_[0-9]views"), X.matches_glob(t, "b+c*")) == [(True, False), (False, False), (True, True)]
    assert values(spark, ["a/b/c.tar.gz", "c", "a/"], *X.path_parts(t)) == [("a/b", "c.tar.gz", "c.tar"), ("", "c", "c"), ("a", "", "")]
    assert values(spark, ["view_e-18_a30", "view_x", None], *X.view_of_name(t)) == [(-18, 30), (None, None), (None, None)]
    assert values(spark, ["view_e0_a30: -1.5e-3", "k : 2", "k: v", ""], *X.labelled_value(t)) == [("view_e0_a30", -0.0015), ("k", 2.0), (None, None), (None, None)]


def test_responses(spark):
    t = F.col("t")
    assert values(spark, ["***a: 1, 22, x3*** 7 ***NONE***", "", None], X.count_in_blocks(t)) == [(2,), (0,), (None,)]
    texts = ["Identified cell numbers: {'a': [1, 2], 'b': [3]}", "Identified cell numbers: {}", "none", None]
    assert values(spark, texts, X.identified_cells(t, F.lit(True)), X.identified_cells(t, F.lit(False))) == [(2, 3), (0, 0), (None, None), (None, None)]
    assert values(spark, ["a END b END", "a"], X.before(t, " END")) == [("a",), ("a",)]
    assert values(spark, ["r"], X.region_words(F.lit(0.2), F.lit(-0.2), F.lit(0.0)), X.region_words(F.lit(0.15), F.lit(0.0), F.lit(-0.15))) == [("right-bottom", "center")]


def test_small_groups_keep_their_largest(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(100)] + [("b", i, 5.0) for i in range(3)] + [("c", i, float(i)) for i in range(10)], "u string, pid long, v double")
    kept = S.top_share(rows, ["u"], "v", 0.1, 4, "pid").groupBy("u").agg(F.sort_array(F.collect_list("pid")).alias("p"))
    assert {r.u: r.p for r in kept.collect()} == {"a": list(range(90, 100)), "b": [0, 1, 2], "c": [6, 7, 8, 9]}
    assert S.top_share(rows.limit(0), ["u"], "v", 0.1, 4, "pid").count() == 0


def test_exact_counts_and_caps(spark):
    rows = spark.createDataFrame([("o", "l", m) for m in "aab"] + [("p", "l", "a")], "object string, load_case string, method string")
    assert [r.object for r in C.units_with_exactly(rows, 2).collect()] == ["o"]
    sizes = spark.createDataFrame([("o", 5.0), ("q", 0.0)], "object string, size double")
    names = spark.createDataFrame([("o",), ("p",), ("q",)], "object string")
    assert [tuple(r) for r in C.capped(names, sizes, ["object"], "size", 10.0).collect()] == [("o", 5.0)]
