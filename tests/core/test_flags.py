"""Flags in biomarker maps, and rows drawn by their place."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from vitalspark.operators import quantiles, recordings, rules, splits


def test_flags_of_maps(spark):
    rows = [(1, {"a": (5.0, 1), "b": (None, 2), "c": (1.0, None)}), (2, {"a": (10.0, 1), "b": (float("nan"), 2)}), (3, {"a": (10.1, 1), "b": None}), (4, {}), (5, None)]
    df = spark.createDataFrame(rows, "id int, m map<string,struct<value:double,tier:int>>").withColumn("m", rules.flagged(F.col("m"), {"a": (5, 10), "b": (0, 1)}))
    found = {r["id"]: r["m"] for r in df.collect()}
    assert {n: v["valid"] for n, v in found[1].items()} == {"a": True, "b": False, "c": False} and found[1]["a"]["tier"] == 1
    assert found[2]["a"]["valid"] and not found[2]["b"]["valid"] and not found[3]["a"]["valid"] and found[3]["b"] is None
    assert found[4] == {} and found[5] is None
    assert rules.flags_long(df, ["id"], "m").count() == 7
    wide = {r["id"]: r for r in rules.flags_wide(df, ["id"], "m", ["a", "c"]).collect()}
    assert (wide[1]["a"], wide[1]["a_valid"], wide[1]["c_valid"]) == (5.0, True, False) and wide[5].asDict() == {"id": 5, "a": None, "a_valid": False, "c": None, "c_valid": False}


def test_rows_at_places(spark):
    ids = random.Random(3).sample(range(10**6), 5000)
    rows = [(i, None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(i % 181)) for i in ids]
    df = spark.createDataFrame(rows, "id long, hr double").repartition(5)
    shares = splits.drawn_shares(60, 4)
    order = sorted(ids)
    found = {r["draw"]: r["v"] for r in quantiles.at_shares(df, F.col("id"), shares).collect()}
    assert found == {k: order[math.floor(u * 5000)] for k, u in shares.items()}
    hr = dict(rows)
    drawn = [hr[order[math.floor(u * 5000)]] for u in shares.values()]
    known = [x for x in drawn if x is not None and x == x]
    r = splits.random_spread(df, "id", "hr", 60, 4).first()
    assert (r["n"], r["low"], r["high"], r["median"]) == (len(known), min(known), max(known), float(np.median(known)))
    none = splits.random_spread(df.where("false"), "id", "hr", 60).first()
    assert none["n"] == 0 and none["median"] is None


def test_the_best_of_a_thousand_splits(spark):
    rnd = random.Random(5)
    rows = [(s, None if rnd.random() < 0.1 else 60.0 + (s * 7 + rnd.randrange(9) * 10) % 90) for s in range(40) for _ in range(rnd.randrange(5, 30))]
    df = spark.createDataFrame(rows, "subject long, target double")
    scores = {r["candidate"]: r for r in recordings.split_balance(df, "subject", 1000, (6, 6)).collect()}
    assert len(scores) == 1000
    best = recordings.best_split(df, "subject", 1000, (6, 6)).collect()
    least = min((r["score"], c) for c, r in scores.items() if r["score"] is not None)
    assert {(r["score"], r["candidate"]) for r in best} == {least} and len(best) == 40
    # The score of the best, from the rows themselves.
    role = {r["subject"]: r["role"] for r in best}
    of = {p: [t for s, t in rows if role[s] == p] for p in recordings.PARTS}
    known = {p: [t for t in x if t is not None] for p, x in of.items()}
    told = {p: (np.mean([t >= 100 for t in x]), np.mean([t >= 120 for t in x]), np.quantile(x, 0.9), np.mean(x)) for p, x in known.items()}
    score = abs(len(of["val"]) - len(of["test"])) / 100
    for p in ("val", "test"):
        gap = [abs(a - b) for a, b in zip(told[p], told["train"])]
        score += gap[0] * 4 + gap[1] * 6 + (gap[2] + gap[3]) / 20 + abs(sum(r == p for r in role.values()) - 6) * 2
    assert abs(score - least[0]) < 1e-9
