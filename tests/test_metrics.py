"""Ranks and percentiles that no task works out alone."""

import random

from pyspark.sql import functions as F

from veilgrain.operators import metrics
from veilgrain.plans import situations, text


def _plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_and_percentiles_are_exact_in_any_bin(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else None, rng.choice([rng.random(), float(rng.randint(0, 9)), 1e300]), rng.choice([None, rng.random()]), rng.randint(1, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z int")
    got = metrics.percentiles(df, {"p50": ("x", 0.5), "p95": ("x", 0.95), "y0": ("y", 0.0), "y1": ("y", 1.0)}, "k")
    want = df.groupBy("k").agg(F.percentile("x", F.lit(0.5)), F.percentile("x", F.lit(0.95)), F.min("y"), F.max("y"))
    near = lambda rows: sorted((r[0] or "", *[round(v, 9) for v in r[1:]]) for r in rows)
    assert near(got.collect()) == near(want.collect())
    df.createOrReplaceTempView("_ranked")
    ranked = spark.sql("select k, rank() over (partition by k order by x) + (count(*) over (partition by k, x) - 1) / 2 a, rank() over (partition by k order by z) + (count(*) over (partition by k, z) - 1) / 2 b from _ranked")
    rho = {r.k: round(r.rho, 6) for r in ranked.groupBy("k").agg(F.corr("a", "b").alias("rho")).collect()}
    assert {r.k: r.rho for r in metrics.spearman(df, "x", "z", "k").collect()} == rho
    assert [(r.n, r.rho) for r in metrics.spearman(df.withColumn("c", F.lit(1)), "c", "z").collect()] == [(3000, None)]


def test_no_window_and_no_map_holds_a_key(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 90).alias("x"), (F.col("id") % 11).alias("y"))
    counts = rows.groupBy("k", "x").agg(F.count("*").alias("n"))
    out = metrics.below(counts, "x", ("n",), "k")
    assert {(r.k, r.x): r.n_below for r in out.collect()} == {(k, x): sum(1 for i in range(200) if i % 2 == k and i * 7 % 90 < x) for k in (0, 1) for x in {i * 7 % 90 for i in range(200) if i % 2 == k}}
    assert "percentile(" not in _plans(metrics.percentiles(rows.select("k", "x"), {"p": ("x", 0.5)}, "k"))
    assert "rank(" not in _plans(metrics.spearman(rows, "x", "y", "k"))


def test_a_small_file_of_much_work_is_dealt_to_all_tasks(spark):
    for make, key in ((situations.fixed_generalizations, "p_partkey"), (situations.relevant_attributes, "c_custkey"), (text.quasi_attributes, "slot_id")):
        plan = _plans(make(spark, "/root/testdata/sf0.001"))
        assert f"hashpartitioning({key}" in plan and "REPARTITION_BY_COL" in plan
