import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vitalspark import schemas
from vitalspark.functions import kernels as K
from vitalspark.functions import labels
from vitalspark.operators import compare, splits, windows
from vitalspark.plans import live
from vitalspark.sources import readers, sinks
from vitalspark.streaming import live as stream


def test_more_text_sources(spark, tmp_path):
    bio = {"scenarios": [{"recordings": {"BIO": [["ECG", "RR"], [0.5, 1], [0.7, None]], "CMS": [["t", "hr"], [0, 70], [1, 300], [2, 74]]}}]}
    (tmp_path / "b.json").write_text(json.dumps(bio))
    row = readers.channel_json(spark, str(tmp_path / "b.json")).first()
    assert row["channels"] == {"ECG": [0.5, 0.7], "RR": [1.0, None]} and row["device_hr"] == 72.0

    (tmp_path / "db.csv").write_text("patient_id,camera,step,age,sex\n1,front,rest,30,F\n2,side,rest,31,M\n3,front,run,x,M\n4,front,rest,,M\n")
    rows = readers.patient_table(spark, str(tmp_path / "db.csv"), "front", ["rest"], {"patient_id": "subject_id", "step": "state"}, ["age", "sex"]).orderBy("subject_id").collect()
    assert [(r["subject_id"], r["state"], r["age"], r["sex"], r["sex_text"]) for r in rows] == [("1", "rest", 30.0, None, "F"), ("4", "rest", None, None, "M")]

    (tmp_path / "clock.txt").write_text("1000,5\nx,6\n1040,\n")
    assert [(r["t"], r["value"]) for r in readers.frame_clock(spark, str(tmp_path / "clock.txt")).orderBy("t").collect()] == [(1000.0, 5.0), (1040.0, None)]
    stamps = spark.createDataFrame([("a", i * 0.04) for i in range(20)] + [("b", i * 0.04) for i in range(5)], "rec string, t double")
    rates = {r["rec"]: r["fps"] for r in readers.frame_rates(stamps, ["rec"], "t", 30.0).collect()}
    assert rates["a"] == pytest.approx(25.0) and rates["b"] == 30.0

    (tmp_path / "info.txt").write_text("s1\nM\n\n Test \n2020_01_02\n")
    assert tuple(readers.subject_info(spark, str(tmp_path / "info.txt")).first())[1:] == ("m", "test", "2020_01_02", "?")
    (tmp_path / "anx").mkdir()
    (tmp_path / "anx" / "a.csv").write_text("1,2\n3,4\n5,6\n")
    (tmp_path / "anx" / "b.csv").write_text("1,2\n3,x\n5,6\n")
    got = sorted(tuple(r)[1:] for r in readers.score_matrix(spark, str(tmp_path / "anx")).collect())
    assert got == [(-1.0,) * 6, (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]

    (tmp_path / "trials.csv").write_text('study,number,state,value,params\nA,0,COMPLETE,5.0,"{""lr"": ""0.1""}"\nA,1,PRUNED,,\nA,2,COMPLETE,4.0,"{""lr"": ""0.2""}"\nB,0,FAIL,,\n')
    best = readers.best_trials(readers.trials(spark, str(tmp_path / "trials.csv"))).collect()
    assert [(r["study"], r["number"], r["params"], r["trials"], r["completed"]) for r in best] == [("A", 2, {"lr": "0.2"}, 3, 2)]

    assert readers.only_file(spark, [str(tmp_path)], "db.csv").endswith("db.csv")
    for name in ("absent.csv", "*.txt"):
        with pytest.raises(FileNotFoundError):
            readers.only_file(spark, [str(tmp_path)], name)


def test_recordings_of_a_corpus(spark, tmp_path):
    kind = schemas.struct(schemas.RECORDING)
    row = {f.name: None for f in kind.fields}
    rows = [row | {"subject_id": "1", "hr_mean": 70.0, "rmssd_ms": -999.0, "roi_rgb": [[[1.0, 2.0, 3.0]]]}, row | {"subject_id": "2", "hr_mean": 60.0}]
    spark.createDataFrame([tuple(r[f.name] for f in kind.fields) for r in rows], kind).write.parquet(str(tmp_path / "c"))
    got = readers.recordings(spark, str(tmp_path / "c")).collect()
    assert [(r["subject_id"], r["hr_mean"], r["rmssd_ms"]) for r in got] == [("1", 70.0, None)]


def test_reports_and_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id int, x double")
    sinks.write_report(df, str(tmp_path / "r"))
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "r")).collect()) == [1, 2]
    with pytest.raises(ValueError):
        sinks.write_report(df.where("false"), str(tmp_path / "r"))
    inventory, seen = spark.range(7).withColumnRenamed("id", "key"), []

    def work(rows):
        seen.append(rows.count())
        if len(seen) == 3:
            raise RuntimeError("broken off")
        return rows.withColumn("status", F.lit("processed"))

    at = {k: str(tmp_path / k) for k in ("out", "log", "stop")}
    with pytest.raises(RuntimeError):
        sinks.run_batches(inventory, ["key"], work, at["out"], at["log"], 3)
    assert sinks.run_batches(inventory, ["key"], work, at["out"], at["log"], 3) == 1 and seen == [3, 3, 1, 1]
    assert spark.read.parquet(at["out"]).count() == spark.read.parquet(at["log"]).count() == 7
    (tmp_path / "stop").write_text("")
    assert sinks.run_batches(inventory.union(spark.range(7, 9)), ["key"], work, at["out"], at["log"], 3, at["stop"]) == 0


def test_buffered_channels_of_a_live_series(spark):
    made = readers.roi_samples(spark, [72.0, 90.0], live.REGIONS, 12.0, 30.0).withColumnRenamed("bpm", "session")
    short = made.where("session = 90 and t_s < 0.5").withColumn("session", F.lit(1.0))
    broken = made.where("session = 90 and t_s < 0.2").withColumns({"session": F.lit(90.0), "t_s": F.col("t_s") + 0.001, "rois": F.map_filter("rois", lambda k, v: k != "forehead")})
    samples = made.unionByName(short).unionByName(broken)
    got = {r["session"]: r for r in live.buffered(samples, ["session"]).collect()}
    assert got[1.0]["status"] == "error" and got[1.0]["pos"] is None and got[72.0]["status"] == "ok" and got[72.0]["window_n"] == 241
    for bpm in (72.0, 90.0):
        rate, _, _ = K.spectral_quality(np.array([got[bpm]["pos"]]), 30.0)
        assert rate[0] == pytest.approx(bpm, abs=2.5)
    dropped = {r["session"]: (r["samples"], r["dropped"]) for r in readers.dropped_samples(samples, ["session"], live.REGIONS).collect()}
    assert dropped == {1.0: (15, 0), 72.0: (360, 0), 90.0: (366, 6)}


def test_candidates_capture_failures(spark):
    wave = lambda base, size: (base + size * np.sin(2 * np.pi * 1.2 * np.arange(360) / 30)).tolist()
    rows = spark.createDataFrame([(1, *([wave(b + k, s) for k in range(3)] for b, s in ((100, 1.8), (105, 3.0), (95, 1.2))))], "id int, r array<array<double>>, g array<array<double>>, b array<array<double>>")
    tail = F.slice(F.get("g", F.lit(0)), 121, 240)
    rows = rows.withColumn("stored", F.struct(*[tail.alias(c) for c in live.CHANNELS]))
    got = {(r["mode"], r["simulated_fps"]): r for r in live.candidates(rows, ["id"], 30.0, 8.0, 12.0, [15.0, 6.0]).collect()}
    assert {k: r["status"] for k, r in got.items()} == {("stored", None): "ok", ("source_buffer", None): "ok", ("simulated_buffer", 15.0): "ok", ("simulated_buffer", 6.0): "failed"}
    for key in (("stored", None), ("source_buffer", None), ("simulated_buffer", 15.0)):
        rate, _, _ = K.spectral_quality(np.array([got[key]["green"]]), 30.0)
        assert rate[0] == pytest.approx(72, abs=2.5), key
    errors = {(r["seconds"], r["channel"]): r for r in live.tone_errors(spark, [60.0, 75.0, 90.0], [8.0, 15.0], 17.6).collect()}
    assert len(errors) == 6 and max(r["max_error"] for r in errors.values()) < 3
    scores = spark.createDataFrame([([1.0, 2.0],), (None,), ([4.0, 5.0, 6.0],)], "x array<double>").select(live.scored(F.col("x"), lambda x: x.mean(axis=1), 1).alias("s")).collect()
    assert [r["s"] for r in scores] == [1.5, None, 5.0]


def test_regions_of_a_frame(spark):
    pixels = spark.createDataFrame([(1, x, y, 100 + x, 120, 255 if x > 2 else 90) for x in range(5) for y in range(4)], "frame int, x int, y int, r int, g int, b int")
    boxes = spark.createDataFrame([(1, "left", 0, 2, 0, 4), (1, "right", 3, 5, 0, 2), (1, "none", 9, 9, 0, 2)], "frame int, region string, x_min int, x_max int, y_min int, y_max int")
    got = {r["region"]: r for r in live.region_samples(pixels, boxes, ["frame"]).collect()}
    assert (got["left"]["r"], got["left"]["status"]) == (100.5, "ok") and got["right"]["status"] == "reject" and got["none"]["reasons"] == "empty"


def test_history_and_windows_of_a_stream(spark, tmp_path):
    ddl = "session_id bigint, stamp timestamp, x double"
    rows = [(1, f"2024-01-01 00:00:{s:02d}", float(s)) for s in range(0, 30, 5)]
    spark.createDataFrame(rows, "session_id bigint, s string, x double").select("session_id", F.to_timestamp("s").alias("stamp"), "x").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    query = stream.fixed_windows(read, "stamp").writeStream.outputMode("complete").format("memory").queryName("fixed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["n"], r["mean_x"]) for r in spark.table("fixed").collect()) == [(3, 5.0), (3, 20.0)]
    for _ in range(2):
        stream.keep_history(read, str(tmp_path / "h"), str(tmp_path / "hc")).awaitTermination(120)
    found = stream.repeatability(spark.read.parquet(str(tmp_path / "h")), ["session_id"], "x").first()
    assert (found["runs"], found["mean"], found["range"]) == (6, 12.5, 25.0)


def test_checks_fail_where_they_should(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.0)], "id int, k string, w double")
    for bad in (splits.checked_weights(rows, "w"), compare.looked_up(rows, F.col("id") > 0, "w", "m"), compare.one_to_one(rows, rows.where("id = 1"), ["id"], "w", "v"), splits.assigned_roles(rows, "k", spark.createDataFrame([("a", "train")], "k string, role string")), compare.only_both(compare.outer_compare(rows, rows.where("id = 1"), ["id"], "w"), ["id"])):
        with pytest.raises(PySparkException):
            bad.collect()
    assert compare.only_both(compare.outer_compare(rows, rows, ["id"], "w"), ["id"]).count() == 2
    assert compare.renamed(rows, {"id": "key"}, {"w": "weight_"}).columns == ["key", "k", "weight_"]
    named = spark.createDataFrame([("AFH2", "AT"), ("BMN1", "CX")], "s string, g string")
    parts = named.select(*[c.alias(k) for k, c in labels.drive_name(F.col("s"), F.col("g"), {"S": "stationary", "T": "talking"}).items()]).collect()
    assert tuple(parts[0]) == ("A", "F", "H", "A", "talking") and tuple(parts[1]) == ("B", "M", "N", "C", "X")
    assert windows.effective_rate(spark.createDataFrame([(1, 0.0), (1, 2.0), (2, 5.0)], "k int, t double"), ["k"], "t").orderBy("k").collect()[0]["rate"] == 0.5


def test_intervals_in_either_unit(spark):
    rows = [(unit, i, v * (1000 if unit == "ms" else 1)) for unit in ("ms", "s") for i, v in enumerate([0.8, 1.0, -1.0, float("nan"), 0.9, 1.1])]
    made = windows.tachogram(spark.createDataFrame(rows, "unit string, i int, rr double"), ["unit"], "rr", ["i"], 7.0).collect()
    by = {u: [(r["k"], r["rr"] / (1000 if u == "ms" else 1)) for r in sorted(made, key=lambda r: r["k"]) if r["unit"] == u] for u in ("ms", "s")}
    at, rr = np.cumsum([0.8, 1.0, 0.9, 1.1]), [0.8, 1.0, 0.9, 1.1]
    assert [k for k, _ in by["ms"]] == [k for k, _ in by["s"]] == list(range(4, 16))
    for unit in by:
        assert [v for _, v in by[unit]] == pytest.approx([np.interp(k / 4, at, rr) for k, _ in by[unit]])
