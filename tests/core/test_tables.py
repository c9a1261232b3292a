import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vitalspark import schemas
from vitalspark.functions import kernels as K
from vitalspark.operators import compare, evaluate, rules, splits, windows
from vitalspark.plans import live
from vitalspark.sources import readers, sinks
from vitalspark.streaming import live as stream


def test_text_sources(spark, tmp_path):
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "a.txt").write_text("1.0 2.0 x 4.0\n60 61 62 63\n0.0 0.5 1.0 1.5\n")
    (tmp_path / "gt" / "b.txt").write_text("1 2 3\n")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in readers.three_row_text(spark, str(tmp_path / "gt")).collect()}
    assert rows["a.txt"]["signal"] == [1.0, 2.0, None, 4.0] and rows["a.txt"]["rate"] == 2.0 and rows["b.txt"]["hr"] is None

    (tmp_path / "bvp.csv").write_text("0.1,5\n0.2,oops\n0.3,7\n")
    assert [r["value"] for r in readers.column_values(spark, str(tmp_path / "bvp.csv")).orderBy("line").collect()] == [5.0, None, 7.0]

    (tmp_path / "ecg.json").write_text(json.dumps({"frequency": 500, "data": [{"title": "V1", "values": [9]}, {"title": "I", "values": [1, 2]}]}))
    row = readers.ecg_json(spark, str(tmp_path / "ecg.json")).first()
    assert (row["rate"], row["values"]) == (500.0, [1.0, 2.0])

    (tmp_path / "x.PW").write_text("10 2024-01-01 00:00:01.500000\n11 2024-01-01 00:00:02.000000\nbad line\n")
    assert [(r["t"], r["value"]) for r in readers.amplitude_text(spark, str(tmp_path / "x.PW")).orderBy("t").collect()] == [(0.0, 10.0), (0.5, 11.0)]

    (tmp_path / "dev.csv").write_text("milliseconds, ECG, ECG HR, SpO2\n1,0.5,0,97\n2,x,61,-1\n")
    got = readers.device_csv(spark, str(tmp_path / "dev.csv")).orderBy("milliseconds").collect()
    assert [(r["ecg"], r["ecg_hr"], r["spo2"]) for r in got] == [(0.5, None, 97.0), (None, 61.0, None)]

    (tmp_path / "log.csv").write_text("subject_id,activity_id,status,skip_reason,hr_mean,rppg_sqi,n_frames,no_face_pct\n01,a,skipped,rppg_sqi_low (0.012),,0.012,100,1.5\n02,b,processed,ok,70,0.5,x,0\n")
    got = readers.processing_log(spark, str(tmp_path / "log.csv"), schemas.LOGS["ubfc_rppg"]).orderBy("subject_id").collect()
    assert [(r["subject_id"], r["skip_code"], r["skip_value"]) for r in got] == [("01", "rppg_sqi_low", 0.012), ("02", "ok", None)]
    for p in ("s1/video.avi", "s1/gt.txt", "s2/video.avi"):
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_text("x")
    found = {r["id"]: r["complete"] for r in readers.inventory(spark, str(tmp_path / "tree"), r"/(s\d+)/([^/]+)$", ["video.avi", "gt.txt"]).collect()}
    assert found == {"s1": True, "s2": False}
    urls = spark.createDataFrame([("data:image/png;base64,aGk=",), ("nope",), (None,)], "u string").select(readers.image_bytes(F.col("u")).alias("b")).collect()
    assert [r["b"] and bytes(r["b"]) for r in urls] == [b"hi", None, None]
    with pytest.raises(KeyError):
        schemas.assert_columns(spark.range(1), ["id", "absent"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, window_role string")
    path = str(tmp_path / "t")
    assert sinks.append_new(df, path, ["id"], "window_role") == 2
    assert sinks.append_new(df.union(spark.createDataFrame([(3, "a")], df.schema)), path, ["id"], "window_role") == 1
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        sinks.write_csv(df.where("false"), str(tmp_path / "c"))
    sinks.write_csv(df, str(tmp_path / "c"))
    nested = spark.createDataFrame([(float("nan"), [1.0, float("inf")], {"k": float("nan")})], "a double, b array<double>, c map<string,double>")
    assert json.loads(nested.select(sinks.json_safe(nested)).first()[0]) == {"a": None, "b": [1.0, None], "c": {"k": None}}


def payload(bpm, fps=30, seconds=8):
    samples = []
    for i in range(int(fps * seconds)):
        p = math.sin(2 * math.pi * bpm / 60 * i / fps)
        rois = {r: {"r": 100 + 0.25 * k + 1.8 * p, "g": 105 + 0.25 * k + 3 * p, "b": 95 + 0.25 * k + 1.2 * p, "quality_status": "ok"} for k, r in enumerate(live.REGIONS)}
        samples.append({"t_s": i / fps, "face_detected": True, "rois": rois})
    return samples


def test_live_analysis_and_prediction(spark):
    good = payload(72)
    broken = payload(90)[:30]
    del broken[3]["rois"]["forehead"]
    bodies = [(1, json.dumps({"samples": good[::-1], "window_seconds": 8})), (2, json.dumps({"samples": broken[:6]})), (3, "not json"), (4, json.dumps({"samples": payload(60, fps=6)}))]
    samples = readers.payloads(spark.createDataFrame(bodies, "session bigint, value string"))
    complete = readers.complete_samples(samples, live.REGIONS)
    assert complete.where("session = 2").count() == 5
    analysed = live.analyse(samples, ["session"])
    got = {r["session"]: r for r in live.predict(analysed).collect()}
    assert got[1]["accepted"] and abs(got[1]["value"] - 72) < 2 and got[1]["state"] == "ok" and got[1]["confidence"] == "good"
    assert not got[2]["accepted"] and got[2]["value"] is None and got[2]["state"] == "waiting"
    assert 3 not in got and got[4]["value"] is None and got[4]["state"] == "skipped"
    assert live.predict(analysed, "absent").where("session = 1").first()["state"] == "unavailable"


def test_model_window_contract(spark):
    df = readers.tones(spark, [60.0, 90.0], 8.0, 30.0)
    ok = df.select(live.valid_input(live.model_window(df)).alias("v"), live.valid_input(F.array("pos", "chrom")).alias("w")).collect()
    assert all(r["v"] and not r["w"] for r in ok)
    found = df.select("bpm", K.quality(F.col("pos"), 30.0).alias("q")).collect()
    assert all(abs(r["bpm"] - r["q"]["bpm"]) < 3 for r in found)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, 1, t / 4, float(t % 7)) for s in (1, 2) for t in range(120)] + [(1, 0, 500.0, 1.0), (2, 2, 3.0, 9.0), (2, 2, None, 9.0)]
    ddl = "session_id bigint, run_id bigint, t double, x double"
    for k in range(3):
        spark.createDataFrame(rows[k::3], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    samples = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.trailing_state(samples).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r["session_id"]: r for r in spark.sql("select session_id, max_by(struct(*), struct(run_id, last_t, n)) r from live group by session_id").select("session_id", "r.*").collect()}
    batch = windows.trailing(spark.createDataFrame(rows, ddl).where("session_id = 1 and run_id = 1"), ["session_id"], "t", 12.0).agg(F.count("*"), F.avg("x")).first()
    assert (last[1]["n"], round(last[1]["mean_x"], 9)) == (batch[0], round(batch[1], 9)) and last[1]["run_id"] == 1
    assert last[2]["run_id"] == 2 and last[2]["n"] == 1


def test_splits_and_samples(spark):
    rows = spark.range(2000).select((F.col("id") % 200).alias("subject"), "id").withColumn("w", F.when(F.col("id") < 1000, 3.0).otherwise(1.0))
    made = splits.hash_split(rows, "subject")
    assert made.groupBy("subject").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    for kind in ("numpy", "python"):
        sizes = {r["split"]: r["n"] for r in splits.shuffled_split(rows, "subject", generator=kind).groupBy("split").agg(F.count_distinct("subject").alias("n")).collect()}
        assert sizes == {"train": 140, "val": 30, "test": 30}
    drawn = splits.weighted_sample(rows, "w", "id", 4000).groupBy((F.col("id") < 1000).alias("heavy")).agg(F.sum("times").alias("n")).collect()
    n = {r["heavy"]: r["n"] for r in drawn}
    assert sum(n.values()) == 4000 and 2.6 < n[True] / n[False] < 3.4


def test_gate_and_comparisons(spark):
    ddl = "id int, pos double, chrom double, green double, sp double, sc double, sg double"
    df = spark.createDataFrame([(1, 72.0, 73.0, 70.0, 0.6, 0.4, 0.2), (2, 72.0, 110.0, 70.0, 0.6, 0.4, 0.2), (3, 72.0, None, 70.0, 0.4, None, 0.35), (4, 72.0, 73.0, 70.0, 0.9, 0.1, 0.1)], ddl)
    gate = rules.quality_gate({c: F.col(c) for c in ("pos", "chrom", "green")}, {"pos": F.col("sp"), "chrom": F.col("sc"), "green": F.col("sg")})
    got = {r["id"]: r for r in df.select("id", *[c.alias(k) for k, c in gate.items()]).collect()}
    assert [got[i]["confidence"] for i in (1, 2, 3, 4)] == ["good", "rejected", "moderate", "rejected"]
    assert got[3]["consensus_bpm"] == 71.0 and got[2]["reasons"] == "channels_disagree" and got[4]["reasons"] == "few_supported_channels"
    with pytest.raises(PySparkException):
        compare.assert_unique(df.union(df), ["id"]).collect()
    assert compare.unfinished(df, df.where("id > 2"), ["id"]).count() == 2
    assert compare.misaligned(df, df.where("id > 1"), ["id"], "pos").count() == 1
    pairs = spark.range(60).select("id", F.col("id").cast("double").alias("target"), (F.col("id") + F.pmod(F.xxhash64("id"), F.lit(5))).cast("double").alias("pred"))
    result = evaluate.permutation_test(pairs, 50).first()
    assert result["r"] > 0.95 and result["p_value"] == pytest.approx(1 / 51) and abs(result["null_mean"]) < 0.1
    nulls = splits.seeded_sample(pairs, [], ["id"], 7)
    assert nulls.count() == 7 and nulls.exceptAll(splits.seeded_sample(pairs, [], ["id"], 7)).count() == 0
    assert np.isclose(evaluate.full_evaluation(evaluate.with_errors(pairs), [], ddof=1).first()["mae"], pairs.select(F.avg(F.abs(F.col("pred") - F.col("target")))).first()[0])
