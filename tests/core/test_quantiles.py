import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from vitalspark.operators import compare, evaluate, quantiles


def brute(rows, share):
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None and v == v:
            groups[k].append(v)
    return {k: float(np.quantile(v, share)) for k, v in groups.items()}


def test_quantiles_are_exact(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.gauss(0, 5), 1.0, 2.0, None, float("nan")])) for _ in range(4000)] + [("one", 7.0), ("none", None), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    found = {r["k"]: r for r in quantiles.quantiles(df, ["k"], F.col("x"), {"low": 0.1, "mid": 0.5, "high": 0.95}).collect()}
    for name, share in (("low", 0.1), ("mid", 0.5), ("high", 0.95)):
        assert {k: r[name] for k, r in found.items()} == pytest.approx(brute(rows, share))
    whole = quantiles.quantiles(df, [], F.col("x"), {"mid": 0.5}).first()
    assert whole["mid"] == pytest.approx(float(np.median([v for _, v in rows if v is not None and v == v])))
    empty = df.where("false")
    assert quantiles.quantiles(empty, ["k"], F.col("x"), {"mid": 0.5}).count() == 0
    assert quantiles.with_quantiles(df.groupBy("k").count(), df, ["k"], {"mid": (F.col("x"), 0.5)}).where("k = 'none'").first()["mid"] is None


def test_mean_ranks_share_ties(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), float(rnd.randrange(50))) for _ in range(900)]
    made = evaluate.with_mean_rank(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", "rank").collect()
    groups = defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    assert len(made) == len(rows)
    for r in made:
        below, ties = sum(v < r["x"] for v in groups[r["k"]]), groups[r["k"]].count(r["x"])
        assert r["rank"] == below + (ties + 1) / 2


def test_empty_bins_are_counted(spark):
    rows = spark.createDataFrame([("a", 50.0), ("a", 55.0), ("b", 130.0), ("b", None)], "k string, target double")
    made = {(r["k"], r["bin"]): (r["n"], r["share"]) for r in evaluate.bin_counts(rows, ["k"], evaluate.cut(F.col("target"), [0.0, 60.0, 200.0], ["low", "high"]), ["low", "high"]).collect()}
    assert made == {("a", "low"): (2, 1.0), ("a", "high"): (0, 0.0), ("b", "low"): (0, 0.0), ("b", "high"): (1, 1.0)}


def test_unique_keys_pass_and_repeated_ones_fail(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "x")], "a int, b string")
    assert compare.assert_unique(df, ["a", "b"]).count() == 3
    with pytest.raises(PySparkException):
        compare.assert_unique(df.union(df), ["a", "b"]).collect()
