"""Tensors from a manifest and recordings: order, values, failures, and readers that notice other tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalspark.functions import kernels as K
from vitalspark.plans import tensors

FRAMES = 24
MANIFEST = "dataset string, subject_id string, recording_id string, start_frame int, end_frame int, window_role string, include_in_finetune boolean, include_in_eval boolean, target_hr_mean double, note array<int>"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    signals = {f"r{i}": {c: rng.normal(size=300) for c in ("pos", "chrom", "green")} for i in range(4)}
    recordings = [("d", "s", name, *[x[c].tolist() for c in ("pos", "chrom", "green")]) for name, x in signals.items()]
    recordings.append((None, "s", "r0", *[signals["r1"][c].tolist() for c in ("pos", "chrom", "green")]))
    rows = [("d", "s", f"r{i % 4}", start, start + 40, role, True, True, 60.0 + start / 10, None) for i in range(40) for start, role in ((i * 6, "finetune_train" if i % 3 else "finetune_val"),)]
    rows += [rows[0], (None, "s", "r0", 8, 48, "finetune_val", None, True, 77.0, [1]), ("d", "s", "r1", 8, 48, "finetune_train", False, True, 77.0, None), ("d", "s", "r1", 8, 48, "finetune_val", True, None, 77.0, None), ("d", "s", "r1", 8, 48, "other", True, True, 77.0, None)]
    return spark.createDataFrame(rows, MANIFEST).repartition(4), spark.createDataFrame(recordings, "dataset string, subject_id string, recording_id string, pos array<double>, chrom array<double>, green array<double>"), rows, signals


def test_a_round_trip(spark, tables, tmp_path):
    manifest, recordings, rows, signals = tables
    shapes = {r["window_role"]: r for r in tensors.build(manifest, recordings, ["finetune_train", "finetune_val"], str(tmp_path / "t"), FRAMES).collect()}
    assert set(shapes) == {"finetune_train", "finetune_val"}
    for role, flag in (("finetune_train", 6), ("finetune_val", 7)):
        want = sorted((r for r in rows if r[5] == role and r[flag]), key=lambda r: (r[0] is not None, r[:4]))
        got = sorted(tensors.read(spark, str(tmp_path / "t"), role).collect(), key=lambda r: r["row_index"])
        assert [r["row_index"] for r in got] == list(range(len(want))) and shapes[role]["rows"] == len(want)
        assert [tuple(r[c] for c in tensors.ORDER) for r in got] == [r[:4] for r in want]
        for r, w in zip(got, want, strict=True):
            own = signals["r1" if w[0] is None else w[2]]
            x = np.concatenate([K.model_ready(own[c][None, w[3] : w[4]], FRAMES)[0] for c in ("pos", "chrom", "green")])
            np.testing.assert_allclose(r["x"], x, atol=1e-5)
            assert r["y"] == pytest.approx(w[8])


def test_failures_and_other_tables_are_noticed(spark, tables, tmp_path):
    manifest, recordings, rows, _ = tables
    odd = [("d", "s", "none", 0, 40, "finetune_train", True, True, 1.0, None), ("d", "s", "r0", 280, 320, "finetune_train", True, True, 1.0, None), ("d", "s", "r0", -1, 39, "finetune_train", True, True, 1.0, None), ("d", "s", "r0", 0, 40, "finetune_train", True, True, None, None), ("d", "s", "r0", 0, 5, "finetune_train", True, True, 1.0, None)]
    more = manifest.unionByName(spark.createDataFrame(odd, MANIFEST))
    with pytest.raises(ValueError, match="no recording"):
        tensors.build(more, recordings, ["finetune_train"], str(tmp_path / "a"), FRAMES)
    tensors.build(more, recordings, ["finetune_train"], str(tmp_path / "b"), FRAMES, strict=False)
    assert sorted(r["failure"] for r in tensors.failures(spark, str(tmp_path / "b")).collect()) == ["no finite signal", "no finite target", "no recording", "outside the recording", "outside the recording"]
    with pytest.raises(ValueError, match="row_index"):
        tensors.read(spark, str(tmp_path / "b"), "finetune_train")
    assert tensors.read(spark, str(tmp_path / "b"), "finetune_train", complete=False).count() == sum(r[5] == "finetune_train" and bool(r[6]) for r in rows)
    with pytest.raises(ValueError, match="no tensors of other"):
        tensors.read(spark, str(tmp_path / "b"), "other")
    # Another table of the same rows: one number is changed.
    tensors.build(manifest, recordings, ["finetune_val"], str(tmp_path / "c"), FRAMES)
    made = spark.read.parquet(str(tmp_path / "c" / "built"))
    changed = made.withColumn("x", F.when(F.col("row_index") == 3, F.reverse("x")).otherwise(F.col("x")))
    changed.write.partitionBy("window_role").parquet(str(tmp_path / "d" / "built"))
    spark.read.parquet(str(tmp_path / "c" / "shapes")).write.parquet(str(tmp_path / "d" / "shapes"))
    with pytest.raises(ValueError, match="checksum"):
        tensors.read(spark, str(tmp_path / "d"), "finetune_val")


def test_tensors_of_buffers(spark, tables, tmp_path):
    manifest = tables[0].where("dataset is not null and recording_id = 'r1'")
    rng = np.random.default_rng(9)
    colours = [(100 + rng.normal(size=(3, 300)).cumsum(axis=1)) for _ in range(3)]
    recordings = spark.createDataFrame([("d", "s", "r1", *[c.tolist() for c in colours])], "dataset string, subject_id string, recording_id string, r array<array<double>>, g array<array<double>>, b array<array<double>>")
    rows = tensors.numbered(tensors.chosen(manifest, ["finetune_train"]), str(tmp_path / "e"))
    made = tensors.buffered_tensors(rows, recordings, 8.0, 8.0, FRAMES).join(rows.select("row_index", "start_frame", "end_frame"), "row_index").collect()
    assert len(made) == rows.count() > 4
    for r in made:
        s = min(max(0, r["end_frame"] - 64), r["start_frame"])
        cube = np.stack([c[:, s : r["end_frame"]] for c in colours], axis=-1)[None]
        full = K.training_signals(cube, 8.0)
        x = np.concatenate([K.model_ready(full[c][:, r["start_frame"] - s :], FRAMES)[0] for c in ("pos", "chrom", "green")])
        np.testing.assert_allclose(r["x"], x, atol=1e-5)


def test_an_empty_manifest(spark, tables, tmp_path):
    manifest, recordings, _, _ = tables
    assert tensors.build(manifest.where("false"), recordings, ["finetune_train"], str(tmp_path / "f"), FRAMES).count() == 0


def test_tables_by_role(spark, tmp_path):
    from vitalspark.sources import sinks

    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "window_role string, x int")
    for _ in range(2):
        sinks.write_by_role(rows, str(tmp_path / "r"))
    found = {(r["window_role"], r["x"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert found == {("a", 1), ("b", 2), (None, 3)}


def test_rows_are_numbered_by_the_place_that_they_were_written_at(spark, tables, tmp_path):
    manifest, _, rows, _ = tables
    found = tensors.numbered(tensors.chosen(manifest, ["finetune_train", "finetune_val"]), str(tmp_path / "n")).collect()
    assert "__at" in spark.read.parquet(str(tmp_path / "n" / "ranges")).columns  # no range is shuffled and sorted again
    for role in ("finetune_train", "finetune_val"):
        own = sorted((r for r in found if r["window_role"] == role), key=lambda r: r["row_index"])
        assert [r["row_index"] for r in own] == list(range(len(own))) and len(own) > 10
        assert own == sorted(own, key=lambda r: (r["dataset"] is not None, r["dataset"], r["subject_id"], r["recording_id"], r["start_frame"]))


def test_kernels_give_their_rows_as_they_are(spark):
    rng = np.random.default_rng(1)
    x = [rng.normal(size=20), None, rng.normal(size=30), np.full(20, np.nan), rng.normal(size=4)]
    made = K.mapped(K.model_ready, 10).func(pd.Series(x, dtype=object))
    assert [v is None for v in made] == [False, True, False, True, True]
    assert isinstance(made[0], np.ndarray)  # lists of Python numbers take most of the time of short windows
    np.testing.assert_array_equal(made[2], K.model_ready(x[2][None], 10)[0])


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf"), float("-inf")])
def test_a_tensor_with_an_odd_number_fails(spark, odd):
    x = [0.0] * (3 * FRAMES - 1)
    rows = spark.createDataFrame([("r", 0, 1.0, False, False, [*x, 1.0]), ("r", 1, 1.0, False, False, [*x, odd]), ("r", 2, 1.0, False, False, x), ("r", 3, 1.0, False, False, None)], "window_role string, row_index long, y float, absent boolean, outside boolean, x array<float>")
    assert [r["failure"] for r in tensors._judged(rows, FRAMES).orderBy("row_index").collect()] == [None, *["no finite signal"] * 3]
