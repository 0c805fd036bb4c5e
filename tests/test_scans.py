"""Running scans, numbering and exact quantiles in two levels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import scans


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_equals_a_loop(spark, width):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.uniform(0.5, 1.5)])) for k in ("a", "b", None) for i in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, i long, x double").where("k is not null").repartition(5)
    found = {(r["k"], r["i"]): r for r in scans.running(df, "i", {"s": ("x", "sum"), "m": ("x", "max"), "p": ("x", "product"), "l": ("x", "min")}, ("k",), width).collect()}
    for k in ("a", "b"):
        seen = []
        for _, i, x in sorted(r for r in rows if r[0] == k):
            seen += [] if x is None else [x]
            r = found[k, i]
            want = [sum(seen), max(seen), float(np.prod(seen)), min(seen)] if seen else [None] * 4
            assert [r["s"], r["m"], r["p"], r["l"]] == pytest.approx(want)


def test_no_task_scans_all_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("i"), F.lit(1.0).alias("x"))
    found = scans.running(df, "i", {"s": ("x", "sum")}, width=500)
    assert found.agg(F.max("s"), F.min("s")).first() == (20_000.0, 1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    single = [part for part in plan.split("Exchange ") if part.startswith("SinglePartition")]
    assert all("_range" in part.split("\n")[1] for part in single)  # only totals of ranges meet in one task


@pytest.mark.parametrize("steps", [2, 1024])
def test_quantiles_equal_the_definition(spark, steps):
    rng = random.Random(2)
    groups = {"ties": [1.0] * 50 + [2.0] * 3, "one": [7.5], "two": [1.0, 2.0], "wide": [rng.lognormvariate(0, 9) for _ in range(400)], "signs": [rng.uniform(-5, 5) for _ in range(99)] + [None] * 20, None: [3.0, 9.0, 4.0], "huge": [-1e308, 1e308, 0.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("nothing", None)]
    rng.shuffle(rows)
    wanted = {"lo": 0.0, "p05": 0.05, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    found = {r["k"]: r for r in scans.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", wanted, steps=steps).collect()}
    assert found.keys() == groups.keys()
    for k, vs in groups.items():
        vs = [v for v in vs if v is not None]
        assert [found[k][n] for n in wanted] == pytest.approx([float(np.quantile(np.array(vs, np.longdouble), q)) for q in wanted.values()])


def test_quantiles_with_weights_and_without_keys(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4)], "v double, n int")
    assert scans.quantiles(df, [], "v", {"m": 0.5, "q": 0.9}, weight="n").collect()[0].asDict() == pytest.approx({"m": float(np.quantile([1, 1, 1, 2, 10, 10, 10, 10], 0.5)), "q": 10.0})


def test_numbers_follow_several_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randint(0, 5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b int, i int").repartition(6)
    found = scans.numbered(df, [F.col("a").desc(), F.col("b"), F.col("i").desc()], "place").collect()
    want = sorted(rows, key=lambda r: (-ord(r[0]), r[1], -r[2]))
    assert [(r["a"], r["b"], r["i"]) for r in sorted(found, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in found) == [*range(300)]
