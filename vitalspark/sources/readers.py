"""Readers of recordings, references and logs; every one goes through the engine's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import signals as S
from ..operators.quantiles import with_quantiles
from ..operators.scans import previous, scan


def _numbers(line: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with a header and a stated schema; cells that don't parse are null."""
    return spark.read.schema(ddl).option("header", True).option("mode", "PERMISSIVE").option("escape", "\"").csv(path)


def processing_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A processing log, its skip reason parted into code and value."""
    reason = F.col("skip_reason")
    return csv(spark, path, ddl).withColumns({"skip_code": F.regexp_extract(reason, r"^(\w+)", 1), "skip_value": F.regexp_extract(reason, r"\(([-0-9.]+)\)", 1).try_cast("double")})


def three_row_text(spark: SparkSession, path: str) -> DataFrame:
    """path, signal, hr, t and rate of files of three rows of numbers; null arrays where rows are missing."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    row = lambda k: F.when(F.size("l") >= 3, _numbers(F.try_element_at("l", F.lit(k))))
    made = files.select("path", row(1).alias("signal"), row(2).alias("hr"), row(3).alias("t"))
    n = F.size("t")
    return made.withColumn("rate", F.when(n >= 2, (n - 1) / (F.element_at("t", -1) - F.element_at("t", 1))))


def column_values(spark: SparkSession, path: str, column: int = -1) -> DataFrame:
    """path, line and value of a delimited file without header: its last column, or the one asked for. line rises within a file but has gaps."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), F.split("value", ",").alias("c"))
    place = F.size("c") if column < 0 else F.lit(column + 1)
    return rows.select("path", "line", F.try_element_at("c", place).try_cast("double").alias("value"))


def ecg_json(spark: SparkSession, path: str) -> DataFrame:
    """path, rate and values of the preferred lead: II, else I, else the first."""
    ddl = "frequency double, data array<struct<title:string,values:array<double>>>"
    rows = spark.read.schema(ddl).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "frequency", "data")
    lead = lambda name: F.try_element_at(F.filter("data", lambda x: x["title"] == name), F.lit(1))
    return rows.select("path", F.col("frequency").alias("rate"), F.coalesce(lead("II"), lead("I"), F.try_element_at("data", F.lit(1)))["values"].alias("values"))


def amplitude_text(spark: SparkSession, path: str) -> DataFrame:
    """path, t (seconds from the first) and value of lines of amplitude, date and time."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("c"))
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.try_element_at("c", F.lit(2)), F.try_element_at("c", F.lit(3))))
    at = rows.select("path", F.try_element_at("c", F.lit(1)).try_cast("double").alias("value"), (F.unix_micros(stamp) / 1e6).alias("s")).where("value is not null and s is not null")
    first = at.groupBy("path").agg(F.min("s").alias("first"))
    return at.join(first, "path").select("path", (F.col("s") - F.col("first")).alias("t"), "value")


def device_csv(spark: SparkSession, path: str) -> DataFrame:
    """A device's CSV whose header has leading blanks: names trimmed, numbers cast, 0 rates as missing."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(*[F.col(f"`{c}`").try_cast("double").alias(c.strip().lower().replace(" ", "_")) for c in rows.columns])
    return rows.withColumns({c: S.from_sentinel(F.col(c), 0.0, -1.0) for c in ("ecg_hr", "ppg_hr", "spo2") if c in rows.columns})


def payloads(raw: DataFrame, body: str = "value") -> DataFrame:
    """Samples of JSON payloads, one a row with its place; bodies that don't parse give none."""
    parsed = raw.withColumn("__p", F.from_json(body, schemas.PAYLOAD))
    rows = parsed.select(*raw.columns, F.col("__p.window_seconds").alias("window_seconds"), F.posexplode(F.coalesce("__p.samples", F.array())).alias("place", "s"))
    return rows.select(*raw.columns, "window_seconds", "place", "s.*")


def complete_samples(samples: DataFrame, regions: list[str]) -> DataFrame:
    """Samples whose time and all colours of all regions are numbers, with colours as columns of arrays by region."""
    ok = S.finite(F.col("t_s")).isNotNull()
    for region in regions:
        for c in "rgb":
            ok = ok & S.finite(F.col("rois")[region][c]).isNotNull()
    kept = samples.where(F.coalesce(ok, F.lit(False)))
    return kept.withColumns({c: F.array(*[F.col("rois")[region][c] for region in regions]) for c in "rgb"})


def inventory(spark: SparkSession, path: str, pattern: str, needed: list[str]) -> DataFrame:
    """id and complete of the folders of a tree: pattern takes (id, file name) out of a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = files.select(F.regexp_extract("path", pattern, 1).alias("id"), F.regexp_extract("path", pattern, 2).alias("file")).where("id <> ''")
    return parts.groupBy("id").agg(F.sort_array(F.collect_set("file")).alias("files")).withColumn("complete", F.size(F.array_intersect("files", F.array(*map(F.lit, needed)))) == len(needed))


def image_bytes(data_url: Column) -> Column:
    """The bytes of a data URL's image; null for anything else."""
    body = F.regexp_extract(data_url, r"^data:image/(?:png|jpeg|jpg);base64,([A-Za-z0-9+/=]+)$", 1)
    return F.when(body != "", F.try_to_binary(body, F.lit("base64")))


def tones(spark: SparkSession, rates: list[float], seconds: float, fps: float, noise: float = 0.05) -> DataFrame:
    """Synthetic POS, CHROM and GREEN windows: a sine of each rate with hashed noise, bpm as the key."""
    n = int(seconds * fps)
    rows = spark.createDataFrame([(float(r),) for r in rates], "bpm double").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = 2 * F.pi() * F.col("bpm") / 60 * F.col("i") / fps
    # A sum of four hashed uniforms stands for a normal deviate.
    wave = lambda k, size, shift: size * F.sin(angle + shift) + noise * sum((F.pmod(F.xxhash64("bpm", "i", F.lit(4 * k + j)), F.lit(1 << 20)) / float(1 << 20) - 0.5 for j in range(4)), F.lit(0.0)) * (3**0.5)
    made = rows.select("bpm", "i", wave(0, 1.0, 0.0).alias("pos"), wave(1, 0.85, 0.15).alias("chrom"), wave(2, 0.70, -0.10).alias("green"))
    packed = made.groupBy("bpm").agg(F.array_sort(F.collect_list(F.struct("i", "pos", "chrom", "green"))).alias("w"))
    return packed.select("bpm", *[F.col(f"w.{c}").alias(c) for c in ("pos", "chrom", "green")])


def roi_samples(spark: SparkSession, rates: list[float], regions: list[str], seconds: float = 8.0, fps: float = 30.0) -> DataFrame:
    """Synthetic colour samples of a pulse at each rate: bpm, t_s and a map of regions, each a little brighter than the one before."""
    wave = F.sin(2 * F.pi() * F.col("bpm") / 60 * F.col("t_s"))
    rows = spark.createDataFrame([(float(r),) for r in rates], "bpm double").withColumn("t_s", F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(seconds * fps) - 1)), lambda i: i / fps)))
    colour = lambda k, base, size: base + 0.25 * k + size * wave
    parts = [x for k, name in enumerate(regions) for x in (F.lit(name), F.struct(colour(k, 100.0, 1.8).alias("r"), colour(k, 105.0, 3.0).alias("g"), colour(k, 95.0, 1.2).alias("b"), F.lit("ok").alias("quality_status")))]
    return rows.select("bpm", "t_s", F.create_map(*parts).alias("rois"))


def dropped_samples(samples: DataFrame, keys: list[str], regions: list[str]) -> DataFrame:
    """Per key, how many samples came and how many were incomplete."""
    whole = complete_samples(samples, regions).groupBy(*keys).agg(F.count(F.lit(1)).alias("complete"))
    came = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    return came.join(whole, keys, "left").select(*keys, "samples", (F.col("samples") - F.coalesce("complete", F.lit(0))).alias("dropped"))


#: What stands for a missing number in stored recordings.
MISSING = (-1.0, -999.0)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet form of a corpus: recordings that have colours, numbers that stand for missing ones as null."""
    rows = spark.read.schema(schemas.RECORDING).parquet(path).where(F.size("roi_rgb") > 0)
    return rows.withColumns({name: S.from_sentinel(F.col(name), *MISSING) for name, kind in rows.dtypes if kind == "double"})


def channel_json(spark: SparkSession, path: str) -> DataFrame:
    """path, device_hr and channels (a map of name to values) of files whose first recording is a table with a heading row.

    device_hr is the median of the plausible rates of the second device; null where it has none.
    """
    kind = "scenarios array<struct<recordings:struct<BIO:array<array<string>>,CMS:array<array<string>>>>>"
    first = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.get(F.from_json("value", kind)["scenarios"], F.lit(0))["recordings"].alias("r"))
    body = lambda rows: F.filter(rows, lambda x, i: i > 0)
    column = lambda rows, at: F.transform(body(rows), lambda x: F.get(x, at).try_cast("double"))
    names = F.get("r.BIO", F.lit(0))
    table = F.map_from_arrays(names, F.transform(names, lambda n, i: column(F.col("r.BIO"), i)))
    place = F.array_position(F.get("r.CMS", F.lit(0)), "hr").cast("int") - 1
    rates = F.array_sort(F.filter(column(F.col("r.CMS"), place), lambda v: (v > 30) & (v < 220)))
    n = F.size(rates)
    middle = F.when(n > 0, (F.try_element_at(rates, F.floor((n - 1) / 2).cast("int") + 1) + F.try_element_at(rates, F.floor(n / 2).cast("int") + 1)) / 2)
    return first.where("r is not null").select("path", middle.alias("device_hr"), table.alias("channels"))


def patient_table(spark: SparkSession, path: str, camera: str, steps: list[str], names: dict[str, str], biomarkers: list[str]) -> DataFrame:
    """Rows of one camera and some steps, columns renamed, biomarkers as numbers where they are numbers and as text beside."""
    rows = spark.read.option("header", True).csv(path).where((F.col("camera") == camera) & F.col("step").isin(steps))
    rows = rows.withColumnsRenamed({a: b for a, b in names.items() if a in rows.columns})
    held = [b for b in biomarkers if b in rows.columns]
    return rows.withColumns({f"{b}_text": F.when(F.col(b).try_cast("double").isNull(), F.col(b)) for b in held} | {b: F.col(b).try_cast("double") for b in held})


def frame_clock(spark: SparkSession, path: str) -> DataFrame:
    """path, t (ms since 1970) and value of lines without heading; lines whose time is no number are left out."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", ",").alias("c"))
    made = rows.select("path", F.get("c", F.lit(0)).try_cast("double").alias("t"), F.get("c", F.lit(1)).try_cast("double").alias("value"))
    return made.where("t is not null")


def frame_rates(stamps: DataFrame, keys: list[str], time: str, fallback: float, least: int = 10, width: float = 600.0) -> DataFrame:
    """Frames a second from the median step of a recording's time stamps in seconds; the fallback for few stamps or no steps. Scanned in buckets of `width` seconds."""
    step = scan(stamps, keys, [time], width, {"__before": previous(F.struct(F.col(time).alias("t")))}).withColumn("step", F.col(time) - F.col("__before.t"))
    found = with_quantiles(stamps.groupBy(*keys).agg(F.count(time).alias("n")), step, keys, {"middle": (F.col("step"), 0.5)})
    return found.select(*keys, F.when((F.col("n") > least) & (F.col("middle") > 0), 1 / F.col("middle")).otherwise(fallback).alias("fps"))


def subject_info(spark: SparkSession, path: str) -> DataFrame:
    """path, gender, scenario, date and time by the lines of small text files; `?` for lines that are absent."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("l"))
    line = lambda k, c=lambda x: x: F.coalesce(c(F.get("l", F.lit(k))), F.lit("?"))
    return files.select("path", line(1, F.lower).alias("gender"), line(2, F.lower).alias("scenario"), line(3).alias("date"), line(4).alias("time"))


#: What the rows and columns of a matrix of self-reported scores are.
SCORES, WHEN = ("cognitive", "somatic", "confidence"), ("pre", "post")


def score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """path and a column for each score before and after, from files of three lines of two numbers; -1 for files of another shape."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    cells = F.transform("l", lambda x: F.transform(F.split(x, ","), lambda v: v.try_cast("double")))
    shaped = F.coalesce((F.size("m") == 3) & F.forall("m", lambda r: (F.size(r) == 2) & F.forall(r, lambda v: v.isNotNull())), F.lit(False))
    made = files.select("path", cells.alias("m"))
    return made.select("path", *[F.when(shaped, F.get(F.get("m", F.lit(i)), F.lit(j))).otherwise(-1.0).alias(f"{s}_{w}") for i, s in enumerate(SCORES) for j, w in enumerate(WHEN)])


def trials(spark: SparkSession, path: str) -> DataFrame:
    """Trials of a search: study, number, state, value and params as a map, from a CSV export with its params as JSON."""
    rows = csv(spark, path, "study string, number int, state string, value double, params string")
    return rows.withColumn("params", F.from_json("params", "map<string,string>"))


def best_trials(rows: DataFrame, n: int = 1) -> DataFrame:
    """The n best completed trials of each study, the earlier of equals first, and how many were completed."""
    done = rows.where("state = 'COMPLETE' and value is not null")
    order = Window.partitionBy("study").orderBy("value", "number")
    counts = rows.groupBy(F.col("study").alias("s")).agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.col("state") == "COMPLETE").alias("completed"))
    best = done.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return best.join(counts, F.col("study") == F.col("s")).drop("s")


def only_file(spark: SparkSession, roots: list[str], name: str) -> str:
    """The path of the one file of a name under some folders; none or several are an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(roots).select("path").distinct().limit(2).collect()
    if len(found) != 1:
        raise FileNotFoundError(f"{name}: {'none' if not found else 'several'} under {roots}")
    return found[0]["path"]
