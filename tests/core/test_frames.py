"""PNG pixels against images made by hand, and the image routes on good, broken and missing frames."""

import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.functions import images
from vitalspark.plans import frames


def chunk(kind, part):
    return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))


def by_hand(lines, width, height, bits, colour, kinds, extra=b"", interlaced=0, parts=1):
    """A PNG of unfiltered lines (bytes), filtered one byte at a time as the format says."""
    unit = max(1, images.CHANNELS[colour] * bits // 8)
    out, before = b"", bytes(len(lines[0]))
    for kind, line in zip(kinds, lines, strict=True):
        row = bytearray()
        for i, v in enumerate(line):
            a, b, c = (line[i - unit] if i >= unit else 0), before[i], (before[i - unit] if i >= unit else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out, before = out + bytes([kind]) + bytes(row), line
    body = zlib.compress(out)
    cuts = [body[i::1][: -(-len(body) // parts)] for i in range(0, len(body), -(-len(body) // parts))]
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced)) + extra + b"".join(chunk(b"IDAT", c) for c in cuts) + chunk(b"IEND", b"")


def url(body, kind="png"):
    return f"data:image/{kind};base64," + base64.b64encode(body).decode()


@pytest.mark.parametrize("kinds", [[0] * 7, [1] * 7, [2] * 7, [3] * 7, [4] * 7, [0, 4, 1, 3, 2, 4, 3]])
@pytest.mark.parametrize(("colour", "bits"), [(0, 8), (2, 8), (4, 8), (6, 8), (0, 16), (2, 16)])
def test_filters_and_colour_types(kinds, colour, bits):
    rng = np.random.default_rng(sum(kinds) + colour)
    channels = images.CHANNELS[colour]
    values = rng.integers(0, 1 << bits, (7, 5, channels))
    lines = [b"".join(int(v).to_bytes(bits // 8, "big") for v in row.ravel()) for row in values]
    pixels, mode = images.decode_png(by_hand(lines, 5, 7, bits, colour, kinds, parts=3))
    top = values >> (bits - 8)
    want = top[..., :3] if colour in (2, 6) else np.repeat(top[..., :1], 3, axis=2)
    assert pixels.dtype == np.uint8 and (pixels == want).all() and mode == images.MODES[colour]


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_palettes_and_few_bits(bits):
    values = np.random.default_rng(bits).integers(0, 1 << min(bits, 3), (3, 5))
    lines = [bytes(int("".join(f"{v:0{bits}b}" for v in row).ljust(-(-5 * bits // 8) * 8, "0")[i : i + 8], 2) for i in range(0, -(-5 * bits // 8) * 8, 8)) for row in values]
    palette = np.random.default_rng(9).integers(0, 256, (8, 3)).astype(np.uint8)
    pixels, mode = images.decode_png(by_hand(lines, 5, 3, bits, 3, [0, 1, 4], chunk(b"PLTE", palette.tobytes())))
    assert (pixels == palette[values]).all() and mode == "P"
    if bits < 8:
        grey, _ = images.decode_png(by_hand(lines, 5, 3, bits, 0, [0, 2, 3]))
        assert (grey == (values * (255 // ((1 << bits) - 1)))[..., None]).all()


def test_encoding_is_undone():
    pixels = np.random.default_rng(1).integers(0, 256, (40, 30, 3)).astype(np.uint8)
    for kinds in (np.arange(40) % 5, np.full(40, 4), np.zeros(40, dtype=int)):
        assert (images.decode_png(images.encode_png(pixels, kinds.astype(np.uint8)))[0] == pixels).all()


def test_broken_images_say_why():
    good = images.encode_png(np.zeros((2, 2, 3), dtype=np.uint8))
    flipped = bytearray(good)
    flipped[45] ^= 255
    wrong = {b"": "unknown format", images.JPEG + b"x": "JPEG", good[:20]: "broken chunk", good[:16]: "no image data", bytes(flipped): "broken chunk", by_hand([b"\0" * 6], 2, 2, 8, 2, [0]): "too short", by_hand([b"\0" * 6], 2, 1, 8, 2, [0], interlaced=1): "interlaced"}
    wrong[images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"x")] = "too many pixels"
    wrong[by_hand([b"\5"], 1, 1, 8, 3, [0], chunk(b"PLTE", b"abc"))] = "palette"
    for body, why in wrong.items():
        with pytest.raises(ValueError, match=why):
            images.decode_png(body)
    for text, why in ((None, "no image"), ("abc", "comma"), ("text,abc", "not an image"), ("data:image/png;base64,", "empty"), ("data:image/png;base64,@@", "base64")):
        with pytest.raises(ValueError, match=why):
            images.payload(text)


def test_routes(spark):
    pixels = np.zeros((6, 8, 3), dtype=np.uint8)
    pixels[:, :4], pixels[:, 4:] = (120, 100, 90), (255, 100, 90)
    box = lambda name, x0, x1, y0, y1: (name, x0, x1, y0, y1)
    boxes = [box("forehead", 0, 4, 0, 6), box("image_left_cheek", 4, 8, 0, 6), box("image_right_cheek", 3, 5, -3, 2), box("out", 8, 9, 0, 6), box("none", None, 1, 0, 1)]
    rows = [(1, url(images.encode_png(pixels)), boxes), (2, url(images.JPEG, "jpeg"), boxes), (3, None, boxes), (4, url(images.encode_png(pixels)), None), (5, url(images.encode_png(pixels)), [])]
    df = spark.createDataFrame(rows, f"id int, image_data_url string, boxes {images.BOX}")
    told = {r["id"]: r for r in frames.frame_summaries(df.drop("boxes")).collect()}
    assert [told[i]["status"] for i in range(1, 6)] == ["received", "unsupported", "error", "received", "received"] and told[2]["message"] == "JPEG"
    assert (told[1]["width"], told[1]["height"], told[1]["channels"], told[1]["mode"]) == (8, 6, 3, "RGB") and told[1]["mean_rgb"]["r"] == 187.5 and told[1]["std_rgb"]["g"] == 0 and told[3]["mean_rgb"] is None
    found = {(r["id"], r["region"]): r for r in frames.frame_regions(df, ["id"]).collect()}
    assert len(found) == 5 + 4
    assert (found[1, "forehead"]["pixels"], found[1, "forehead"]["quality_status"], found[1, "forehead"]["usable"]) == (24, "ok", True)
    assert found[1, "image_left_cheek"]["quality_status"] == "reject" and "red_saturated" in found[1, "image_left_cheek"]["reasons"]
    assert found[1, "image_right_cheek"]["pixels"] == 4 and found[1, "image_right_cheek"]["mean_rgb"]["r"] == 187.5
    assert found[1, "out"]["reasons"] == found[1, "none"]["reasons"] == "empty" and found[1, "out"]["mean_rgb"] is None
    assert found[2, None]["status"] == "unsupported" and found[2, None]["usable"] is None and found[4, None]["status"] == "received"
    compact = {r["id"]: r for r in frames.roi_samples(df, ["id"]).collect()}
    assert compact[1]["status"] == "processed" and (compact[1]["debug"]["roi_count"], compact[1]["debug"]["usable_roi_count"], compact[1]["debug"]["quality_summary"]) == (5, 1, "reject")
    assert compact[1]["rois"]["forehead"].asDict() == {"r": 120.0, "g": 100.0, "b": 90.0, "quality_status": "ok"} and set(compact[1]["rois"]) == {"forehead", "image_left_cheek", "image_right_cheek"}
    assert compact[2]["status"] == "unsupported" and compact[2]["debug"]["quality_summary"] == "unknown" and compact[5]["debug"]["roi_count"] == 0
    assert frames.roi_samples(df.where("false"), ["id"]).count() == 0


def test_a_frame_feeds_the_live_analysis(spark):
    from vitalspark.plans import live

    rows = []
    for i in range(90):
        p = np.sin(2 * np.pi * 1.2 * i / 15.0)
        pixels = np.zeros((12, 12, 3))
        pixels[:] = 120 + 3 * p, 105 + 12 * p, 95 + 2 * p
        rows.append((7, i / 15.0, url(images.encode_png(np.rint(pixels).astype(np.uint8))), [(r, k * 4, k * 4 + 4, 0, 12) for k, r in enumerate(live.REGIONS)]))
    df = spark.createDataFrame(rows, f"session int, t_s double, image_data_url string, boxes {images.BOX}")
    samples = frames.roi_samples(df, ["session", "t_s"])
    found = live.analyse(samples, ["session"]).first()
    assert found["n"] == 90 and found["green_bpm"] == pytest.approx(72, abs=5)
    assert samples.where(F.col("debug.usable_roi_count") == 3).count() == 90
