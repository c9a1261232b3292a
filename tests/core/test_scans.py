"""Ordered scans against pandas, on short recordings and on one of a million rows."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalspark.operators import scans, windows


def windows_of(df):
    """The keys that each window of a plan is parted by."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys).split(", ") for keys in re.findall(r"(?:^|\n)[ :+-]*Window \[.*\], \[([^\]]*)\], \[", plan)]


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(2)
    rows = []
    for rec in ("a", "b", None, "one", "unknown"):
        n = {"one": 1, "unknown": 5}.get(rec, 400)
        t = np.sort(rng.choice(4000, n, replace=False)) / 8.0 - 100
        for i in range(n):
            known = rec != "unknown" and rng.random() < 0.3
            rows.append((rec, float(t[i]), float(rng.normal()) if known or rec == "one" else None))
    return spark.createDataFrame(rows, "rec string, t double, x double").repartition(5).cache(), pd.DataFrame(rows, columns=["rec", "t", "x"])


@pytest.mark.parametrize(("width", "group"), [(10.0, 4), (0.5, 3), (1e9, 1024)])
def test_a_scan_is_that_of_the_whole_recording(monkeypatch, small, width, group):
    monkeypatch.setattr(scans, "GROUP", group)
    df, pdf = small
    carried = {"past": scans.last(F.col("x")), "before": scans.previous(F.col("x")), "row": scans.previous(F.struct(F.col("x").alias("v"))), "coming": scans.following(F.col("x")), "total": scans.running_sum(F.col("x")), "least": scans.running_least(F.col("x"))}
    found = scans.scan(df, ["rec"], ["t"], width, carried)
    assert all(keys[-1] in ("__b", "__c") for keys in windows_of(found)) and windows_of(found)
    got = found.toPandas()
    assert len(got) == len(pdf) and got.columns.tolist() == ["rec", "t", "x", *carried]
    for rec, want in pdf.groupby("rec", dropna=False):
        want = want.sort_values("t")
        have = got[got["rec"].isna() if rec is None or rec != rec else got["rec"] == rec].sort_values("t")
        x = want["x"].astype(float).reset_index(drop=True)
        for name, series in (("past", x.ffill()), ("before", x.ffill().shift()), ("coming", x.bfill()), ("total", x.cumsum().ffill()), ("least", x.cummin().ffill())):
            np.testing.assert_allclose(have[name].to_numpy(dtype=float), series.to_numpy(), err_msg=f"{rec} {name}")
        lag = [np.nan if r is None or r["v"] is None else r["v"] for r in have["row"]]
        np.testing.assert_allclose(np.array(lag, dtype=float), x.shift().to_numpy())
        assert have["row"].iloc[0] is None


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", None, 5.0), ("a", 1.0, None), ("a", 2.0, 7.0)], "rec string, t double, x double")
    found = {r["t"]: r["p"] for r in scans.scan(rows, ["rec"], ["t"], 10.0, {"p": scans.last(F.col("x"))}).collect()}
    assert found == {None: 5.0, 1.0: 5.0, 2.0: 7.0}
    assert scans.scan(rows.where("false"), ["rec"], ["t"], 10.0, {"p": scans.last(F.col("x")), "n": scans.following(F.col("x"))}).count() == 0


def test_one_recording_of_a_million_rows(spark):
    n = 1_000_000
    rows = spark.range(0, n, 1, 8).select(F.lit("long").alias("rec"), (F.col("id") / 100.0).alias("t"), F.when(F.col("id") % 1000 == 7, F.col("id").cast("double")).alias("x"))
    hour = 600.0
    made = windows.filled(rows, ["rec"], "t", "x", hour)
    assert all("__b" in k or "__c" in k for k in windows_of(made))
    found = made.agg(F.count("x").alias("n"), F.sum("x").alias("s")).first()
    ids = np.arange(n)
    want = np.where(ids < 7, 7, (ids - 7) // 1000 * 1000 + 7)
    assert (found["n"], found["s"]) == (n, float(want.sum()))
    line = windows.interpolated(rows, ["rec"], "t", "x", hour).where((F.col("t") > 1) & (F.col("t") < 9000)).agg(F.max(F.abs(F.col("x") - F.col("t") * 100)).alias("e")).first()
    assert line["e"] < 1e-6
    dense = rows.select("rec", "t", F.lit(1.0).alias("x"))
    sums = windows.changes(dense, ["rec"], "t", "x", hour)
    assert all("__b" in k or "__c" in k for k in windows_of(sums))
    found = sums.agg(F.max(F.abs(F.col("running") - (F.col("t") * 100 + 1))).alias("e"), F.sum("step").alias("steps"), F.sum("share").alias("whole"), F.count("step").alias("n")).first()
    assert found["e"] < 1e-4 and found["steps"] == 0 and found["whole"] == pytest.approx(1) and found["n"] == n - 1
    beats = rows.select("rec", "t", (F.lit(800.0) + F.pmod(F.round(F.col("t") * 100).cast("long"), F.lit(2)) * 100).alias("rr"))
    hrv = windows.heart_rate_variability(beats, ["rec"], "rr", ["t"], hour)
    assert all("__b" in k or "__c" in k for k in windows_of(hrv))
    r = hrv.first()
    assert (r["n"], r["mean_rr"], r["pnn50"]) == (n, pytest.approx(850), 100.0) and r["rmssd"] == pytest.approx(100)
    latest = windows.as_of(rows.select("rec", "t"), rows.where("x is not null").select("rec", "t", F.col("x").alias("hr")), ["rec"], "t", "hr", hour)
    assert all("__b" in k or "__c" in k for k in windows_of(latest))
    assert latest.agg(F.sum("hr")).first()[0] == float(want[7:].sum())
    tacho = windows.tachogram(beats.where("t < 2000"), ["rec"], "rr", ["t"], hour)
    assert all(k[-1] in ("__b", "__c", "cell", "g") for k in windows_of(tacho))
    found = tacho.agg(F.count("k").alias("n"), F.count_distinct("k").alias("d"), F.min("rr").alias("low"), F.max("rr").alias("high")).first()
    seconds = 100_000 * 0.8 + 100_000 * 0.9
    assert found["n"] == found["d"] == pytest.approx(seconds * 4, abs=8) and 800 <= found["low"] and found["high"] <= 900


@pytest.fixture
def dealt(spark):
    """Rows that come dealt by recording: what follows would be joined, summed up and sorted in the same tasks, all in memory at once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = spark.range(1000).select((F.col("id") % 7).alias("rec"), F.col("id").cast("double").alias("t"), F.col("id").alias("x"))
    yield rows.join(rows.groupBy("rec").agg(F.min("t").alias("first")), "rec")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt_by(df, keys):
    """How often a plan deals rows anew by keys."""
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    return len(re.findall(rf"Exchange hashpartitioning\({keys}, \d+\), REPARTITION_BY_COL", plan))


def test_a_scan_is_not_made_where_a_recording_is_dealt(dealt):
    found = scans.scan(dealt, ["rec"], ["t"], 10.0, {"past": scans.last(F.col("x")), "coming": scans.following(F.col("x"))})
    assert dealt_by(found, "rec, __b") >= 3  # the rows, and the summaries before and after


def test_a_crop_finds_spans_elsewhere_than_it_joins_them(dealt):
    found = windows.crop(dealt.where("x % 2 = 0"), dealt.where("x % 2 = 1"), ["rec"], "t", 5.0)
    assert dealt_by(found, "rec, t") >= 2
    rows = dealt.toPandas()
    clock = rows[rows.x % 2 == 1].groupby("rec").t
    want = [x for r, t, x in rows[rows.x % 2 == 0][["rec", "t", "x"]].itertuples(index=False) if clock.min()[r] <= t <= clock.max()[r]]
    assert sorted(r["x"] for r in found.collect()) == sorted(want)


def test_a_tachogram_of_a_known_unit_takes_every_interval(spark):
    rows = [("a", 0, 800.0), ("a", 1, 0.0), ("a", 2, 1000.0), ("b", 0, None), ("b", 1, 500.0), ("b", 2, None), ("b", 3, 500.0), ("c", 0, 10.0), ("c", 1, 12.0)]
    made = windows.tachogram(spark.createDataFrame(rows, "rec string, i int, rr double").repartition(3), ["rec"], "rr", ["i"], 2.0, per_second=1000.0)
    assert sorted((r["rec"], r["k"], r["rr"] and round(r["rr"], 9)) for r in made.collect()) == [("a", 4, 200.0), ("a", 5, 450.0), ("a", 6, 700.0), ("a", 7, 950.0), ("b", 2, None), ("b", 3, None)]
