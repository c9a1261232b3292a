"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are multiplied for each language:

* the likelihood of the text under byte-trigram models, tempered so that a long text counts as
  `EVIDENCE` independent trigrams at most (neighbouring trigrams say much the same);
* the likelihood of the declared markup language;
* the likelihood of the address suffix;
* a prior of the host, smoothed towards its domain, that towards all rows.

The last three are tables of soft counts: a grouped sum of the text's own posteriors. A row's own
count is taken off before it is judged, so no row is evidence for itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, held, materialise, texts_of

#: Labelled rows and languages that fitting reads at most; trigrams that a text counts for at most; table size.
SAMPLE, LANGUAGES, EVIDENCE, BUCKETS = 8_000, 64, 40, 1 << 16
#: Weight of each level's parent in a host's prior, and of the uniform in the likelihood tables.
KAPPA, ALPHA = 4.0, 1.0


def trigrams(text: str) -> np.ndarray:
    """Table places of the byte trigrams of the lower-cased letters of a text, single spaces between words."""
    data = " ".join(_letters(text).split()).encode()
    if not data:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


_NOT_LETTERS = {i: " " for i in range(128) if not chr(i).isalpha()}


def _letters(text: str) -> str:
    return text.translate(_NOT_LETTERS).lower()


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # log-likelihood of each trigram place, a row a language

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Tempered log-likelihood of each text under each language; 0 for texts without letters."""
        out = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            places = trigrams(text)
            if len(places):
                mean = [row[places].mean() for row in self.table]
                out[i] = np.array(mean) * min(len(places), EVIDENCE)
        return out


def fit_text(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, most: int = LANGUAGES) -> TextModel:
    """Trigram models of the `most` most frequent languages of a labelled table, from at most `sample` rows of it.

    The rows are those of the smallest hashes of key and text, so that copies count as often as
    they are; rows that agree in both come together. Null labels and texts teach nothing. Only the counts, a row a language and place, come to
    the driver. Without labels there is one language, "und".
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang).limit(most).collect()
    rows = rows.where(F.col(lang).isin([r[lang] for r in sizes]))
    # A cut of the hash, from the number of rows, leaves about twice the sample; among those the exact bound is found.
    share = min(1.0, 2 * sample / max(1, sum(r["n"] for r in sizes)))
    place = F.pmod(F.xxhash64(key, text), F.lit(1 << 40))
    near = rows.where(place <= int(share * (1 << 40)))
    last = near.select(place.alias("place")).orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    kept = near.where(place <= F.lit(last)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            found: dict[str, np.ndarray] = {}
            for name, x in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                found.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                found[name] += np.bincount(trigrams(x), minlength=BUCKETS)
            for name, counts in found.items():
                places = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array(places), pa.array(counts[places])], names=["lang", "place", "n"])

    counts = kept.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counts}) or ["und"]
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in counts:
        table[languages.index(r["lang"]), r["place"]] += r["n"]
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def with_text_evidence(df: DataFrame, model: TextModel, text: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add `evidence`, the log-likelihood of the text under each of the model's languages."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language

    def start():
        own = shared.value
        return lambda texts: [own.likelihoods(texts).tolist()]

    return append_columns(df, text, [T.StructField("evidence", T.ArrayType(T.DoubleType()))], start, drop)


def softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _counts(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Soft counts of each language a group, as one array column; null keys are no group."""
    sums = [F.sum(F.col("own")[i]).alias(f"c{i}") for i in range(n)]
    kept = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)
    return materialise(kept.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"c{i}" for i in range(n)]).alias(name)), name)


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def prior_tables(evidence: DataFrame, languages: list[str]) -> dict[str, DataFrame | list[float]]:
    """Grouped soft counts of hosts, domains, suffixes, declared languages and all rows.

    evidence: columns evidence, host, domain, suffix, declared; any of them may be null.
    """
    n = len(languages)
    own = evidence.select("host", "domain", "suffix", "declared", softmax(F.col("evidence")).alias("own"))
    total = own.agg(*[F.coalesce(F.sum(F.col("own")[i]), F.lit(0.0)).alias(f"c{i}") for i in range(n)]).first()
    return {
        "all": [float(total[i]) for i in range(n)],
        "host": _counts(own, ["host"], n, "host_counts"),
        "domain": _counts(own, ["domain"], n, "domain_counts"),
        "suffix": _counts(own, ["suffix"], n, "suffix_counts"),
        "declared": _counts(own, ["declared"], n, "declared_counts"),
    }


def fuse(df: DataFrame, tables: dict, languages: list[str]) -> DataFrame:
    """Add `posterior` array, `language` and `confidence` to rows with evidence, host, domain, suffix, declared.

    The tables are joined plainly: Spark broadcasts those below its threshold and splits a hot host
    otherwise. Nulls in any evidence leave it out; with no evidence at all the prior of all rows
    decides. Ties go to the language that sorts first.
    """
    n = len(languages)
    joined = df.withColumn("own", softmax(F.col("evidence")))
    for name in ("host", "domain", "suffix", "declared"):
        joined = joined.join(tables[name], name, "left")
    zero = F.array(*[F.lit(0.0)] * n)
    without = lambda name: F.coalesce(_zip(F.col(f"{name}_counts"), F.col("own"), lambda c, o: F.greatest(c - o, F.lit(0.0))), zero)
    total = F.array(*[F.lit(x) for x in tables["all"]])
    everything = _zip(total, F.col("own"), lambda c, o: F.greatest(c - o, F.lit(0.0)))
    joined = joined.withColumn("g", everything)
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    joined = joined.withColumn("prior", F.transform("g", lambda c: (c + 1.0) / (size(F.col("g")) + n)))
    for name in ("domain", "host"):  # the suffix is evidence of its own, below
        joined = joined.withColumn("c", without(name))
        joined = joined.withColumn("prior", _zip(F.col("c"), F.col("prior"), lambda c, p: (c + KAPPA * p) / (size(F.col("c")) + KAPPA)))
    # P(seen | language): how often rows of a language carry this declaration or this suffix.
    likely = lambda name: F.when(F.col(name).isNull() | F.col(f"{name}_counts").isNull(), zero).otherwise(
        _zip(without(name), F.col("g"), lambda c, g: F.log((c + ALPHA) / (g + ALPHA * 20)))
    )
    joined = joined.withColumn("by_declared", likely("declared")).withColumn("by_suffix", likely("suffix"))
    logs = _zip(
        _zip(F.col("evidence"), F.col("prior"), lambda e, p: e + F.log(p)), _zip(F.col("by_declared"), F.col("by_suffix"), lambda a, b: a + b), lambda a, b: a + b
    )
    joined = joined.withColumn("posterior", softmax(logs))
    best = F.array_max("posterior")
    names = F.array(*map(F.lit, languages))
    place = F.array_position("posterior", best).cast("int")
    drop = ["own", "g", "c", "prior", "by_declared", "by_suffix", *[f"{k}_counts" for k in ("host", "domain", "suffix", "declared")]]
    return joined.withColumns({"language": F.element_at(names, place), "confidence": best}).drop(*drop)


def page_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles, comments, tags and entities become spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def page_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id with evidence, declared language, host, domain and suffix of each page."""
    empty = lambda c: F.when(c != "", c)
    address = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(
        "page_id",
        empty(host).alias("host"),
        empty(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        empty(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"),
        empty(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))).alias("declared"),
        page_text(F.coalesce("html", F.lit(""))).alias("visible"),
    )
    return with_text_evidence(rows, model, "visible", drop=("visible",))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, language, confidence, declared, host and text_language of every page.

    Null or empty pages have no text evidence and are judged by their address and declaration,
    or by the prior alone. Repeated rows stay; an empty table gives an empty one.
    """
    evidence = held(page_evidence(pages, model))
    fused = fuse(evidence, prior_tables(evidence, model.languages), model.languages)
    names = F.array(*map(F.lit, model.languages))
    by_text = F.element_at(names, F.array_position("evidence", F.array_max("evidence")).cast("int"))
    return fused.select("page_id", "language", "confidence", "declared", "host", by_text.alias("text_language"))


def filter_documents(docs: DataFrame, model: TextModel, text: str = "text", declared: str = "lang", host: str = "source", least: float = 0.01) -> DataFrame:
    """The documents whose declared language keeps a posterior of at least `least`.

    Documents that declare nothing, or a language that the model doesn't know, stay; so do texts
    without letters, for which the declaration is all there is. Rows come back as they were.
    """
    columns = docs.columns
    nothing = F.lit(None).cast("string")
    packed = docs.select(
        F.struct(*columns).alias("row"), F.lower(F.col(declared)).alias("declared"), F.col(host).alias("host"), nothing.alias("domain"), nothing.alias("suffix")
    )
    light = packed.select("declared", "host", "domain", "suffix", F.col(f"row.{text}").alias("body"))
    tables = prior_tables(held(with_text_evidence(light, model, "body", drop=("body",))), model.languages)
    fused = fuse(with_text_evidence(packed, model, f"row.{text}"), tables, model.languages)
    names = F.array(*map(F.lit, model.languages))
    place = F.array_position(names, F.col("declared")).cast("int")
    kept = F.col("declared").isNull() | (place == 0) | (F.element_at("posterior", F.greatest(place, F.lit(1))) >= least)
    return fused.where(kept).select("row.*")
