"""A toxicity classifier regularised by counterfactual sentences.

The score is a logistic model over words and word beginnings. Besides the usual loss it pays for
every labelled sentence that names a group: the term is swapped for each other term of its kind,
and the squared change of the score is added to the loss. So the model cannot lean on the mention
of a group, and neutral mentions are not taken for toxic ones.

Fitting reads at most `sample` labelled rows, those of the smallest hashes: their features are
counted in Spark, the significant ones chosen, and only the chosen features of each row, a few
integers, come to the driver. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialise, texts_of

#: Labelled rows that fitting reads at most, features of the model, least |z| of a feature.
SAMPLE, FEATURES, LEAST_Z = 20_000, 4096, 4.0

#: Lengths of word beginnings that are features.
STARTS = (4, 5, 6, 7)

#: Terms that name groups, by kind; within a kind and language any may stand for another.
IDENTITY = {
    "en": [
        ["women", "men", "girls", "boys"],
        ["woman", "man", "girl", "boy"],
        ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
        ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
        ["black", "white", "asian", "latino", "african", "european"],
        ["gay", "straight", "lesbian", "bisexual", "transgender"],
        ["immigrants", "refugees", "natives", "foreigners"],
        ["old", "young", "elderly", "disabled"],
    ],
    "de": [
        ["frauen", "männer", "mädchen", "jungen"],
        ["muslime", "christen", "juden", "hindus"],
        ["schwarze", "weiße", "asiaten"],
        ["ausländer", "flüchtlinge", "einheimische"],
    ],
    "fr": [
        ["femmes", "hommes", "filles", "garçons"],
        ["musulmans", "chrétiens", "juifs", "hindous"],
        ["noirs", "blancs", "asiatiques"],
        ["immigrés", "réfugiés", "étrangers"],
    ],
    "es": [
        ["mujeres", "hombres", "niñas", "niños"],
        ["musulmanes", "cristianos", "judíos", "hindúes"],
        ["negros", "blancos", "asiáticos"],
        ["inmigrantes", "refugiados", "extranjeros"],
    ],
}
#: A term and the others of its kind.
SWAPS = {term: [x for x in kind if x != term] for kinds in IDENTITY.values() for kind in kinds for term in kind}

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings of four to seven letters; group terms stand alone."""
    if word in SWAPS:
        return (word,)
    return (word, *(word[:n] + "*" for n in STARTS if len(word) >= n))


def row_features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def counterfactuals(words: set[str]) -> list[tuple[str, str]]:
    """(term, other term) for every swap that the words of a text allow."""
    return [(w, other) for w in words if w in SWAPS for other in SWAPS[w]]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0

    def kernel(self):
        """A function from texts to scores; what a word adds to a text is remembered."""
        starts = {f[:-1] for f in self.weights if f.endswith("*")}
        known = frozenset(f for f in self.weights if not f.endswith("*"))

        def score(text: str) -> float:
            words = words_of(text)
            found = {w for w in words if w in known or w[:4] in starts or w[:5] in starts or w[:6] in starts or w[:7] in starts}
            total = self.bias + sum(self.weights.get(f, 0.0) for f in row_features(found))
            return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

        return score


def fit_rows(rows: list[tuple[int, list[int], list[list[int]]]], n: int, fairness: float = 10.0, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias from rows (label, features, swaps), a swap [feature lost, feature gained] or -1.

    Loss: mean log loss + ridge |w|^2 / n rows + fairness * mean squared change of the score's
    logit over all swaps. Minimised by Adam on full batches.
    """
    if not rows:
        return np.zeros(n), -2.0
    y = np.array([r[0] for r in rows], dtype=float)
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    which = np.array([f for r in rows for f in r[1]], dtype=int)
    swaps = np.array([s for r in rows for s in r[2]], dtype=int).reshape(-1, 2)
    w, bias = np.zeros(n + 1), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(n + 2), np.zeros(n + 2)
    for t in range(1, steps + 1):
        z = bias + np.bincount(owner, w[which], minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = (p - y) / len(y)
        grad = np.bincount(which, slope[owner], minlength=n + 1) + 2 * ridge * w / len(y)
        if len(swaps):
            change = w[swaps[:, 1]] - w[swaps[:, 0]]
            pull = 2 * fairness * change / len(swaps)
            grad += np.bincount(swaps[:, 1], pull, minlength=n + 1) - np.bincount(swaps[:, 0], pull, minlength=n + 1)
        grad[n] = 0.0  # -1, a feature outside the model, has weight 0
        full = np.append(grad, slope.sum())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w[:n], float(bias)


def below(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """Rows of the smaller hashes of a key, about twice `most` of them, so that an exact limit has little to sort."""
    share = 2 * most / max(1, rows.count())
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64(key, F.lit(0)), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, fairness: float = 10.0) -> Model:
    """Fit on at most `sample` rows of labels (key, label), chosen by the hash of the key.

    Rows whose key or label is null teach nothing; null texts count as empty; of the rows of a
    repeated key the least (label, text) teaches. Without labels the model has no weights and
    scores every text alike, below one half.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("y"))
    smallest = [F.xxhash64(F.col(key), F.lit(0)), F.col(key), F.col("y")]
    chosen = below(usable, F.col(key), sample).orderBy(*smallest).limit(sample)
    joined = docs.select(key, text).join(F.broadcast(chosen), key).select(key, F.struct("y", F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"))
    train = materialise(joined.groupBy(key).agg(F.min("row").alias("row")).select("row.*"), "sample")  # a row a key
    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    negative, positive = size.get(0, 0), size.get(1, 0)
    if not negative or not positive:
        return Model(bias=-2.0 if negative or not positive else 2.0)

    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for y, words in zip(batch.column(0).to_pylist(), map(words_of, texts_of(batch, "text")), strict=True):
                for f in row_features(words):
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in (0, 1))], names=["feature", "n0", "n1"])

    counts = train.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 5")
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    c, d = positive - F.col("n1") + 0.5, negative - F.col("n0") + 0.5
    z = (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    best = counts.select("feature", F.abs(z).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(features)
    names = sorted({r["feature"] for r in best.collect()} | set(SWAPS))
    place = {f: i for i, f in enumerate(names)}

    def chosen_features(batches):
        for batch in batches:
            rows = []
            for y, words in zip(batch.column(0).to_pylist(), map(words_of, texts_of(batch, "text")), strict=True):
                found = sorted(place[f] for f in row_features(words) if f in place)
                rows.append((y, found, [place[x] for swap in counterfactuals(words) for x in swap]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["y", "found", "swaps"])

    rows = train.mapInArrow(chosen_features, "y int, found array<int>, swaps array<int>").collect()  # at most `sample`
    rows = sorted((r["y"], r["found"], [r["swaps"][i : i + 2] for i in range(0, len(r["swaps"]), 2)]) for r in rows)
    weights, bias = fit_rows(rows, len(names), fairness)
    return Model({f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-6}, bias)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add `score` double in 0 to 1 to every row; null and empty texts get the model's bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def start():
        rate = shared.value.kernel()
        return lambda texts: [[rate(x) for x in texts]]

    return append_columns(docs, text, [T.StructField(name, T.DoubleType())], start, drop)


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, as they were; null and empty texts have the model's bias, repeated rows stay."""
    rows = score(docs.select(F.struct(*docs.columns).alias("row")), model, f"row.{text}")
    return rows.where(F.col("score") < threshold).select("row.*")
