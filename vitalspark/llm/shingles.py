"""Near copies by shingles: SimHash tries give candidates, exact Jaccard decides.

Texts of equal shingle sets are one node. Nodes that `tries` finds near each other are candidates;
one trie of 64 bits can't give them: at a Jaccard of 0.8 about ten bits differ, with a deviation of
three, and a budget that misses few pairs prunes nothing.

A large family of near copies would meet in all its pairs. So every node is compared with up to three of
its neighbours at first, and what agrees becomes one component; then the closest pair of every two
components is compared, and last all pairs of those that are still apart, so none is left out. Three
bounds, all exact, keep distant copies apart. A shingle that no other candidate node has is in no
intersection, so the `shared` shingles of a node bound its Jaccard with every other. Two nodes that
have no shingle of `RARE` nodes at most in common have only `common` shingles in their intersection.
And each bit in which the parities of two sets differ is a shingle that one of them alone has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tries
from .common import append_columns, components, held, materialise
from .simhash import hashes

#: Words of a shingle, least Jaccard of near copies.
WIDTH, LEAST = 5, 0.8
#: Nodes of a rare shingle at most.
RARE = 16
#: Bands and minima of a band of a MinHash sketch.
BANDS, ROWS = 24, 5
#: Shingles hashed at a time.
STEP = 4096

_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a shorter text is one shingle."""
    return np.unique(np.array(hashes(text, width, seed), dtype=np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """Least value of a set under each of the hash functions; ones for an empty set."""
    out = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), STEP):
        some = found[at : at + STEP]
        for k, (times, plus) in enumerate(_SEEDS.T):
            out[k] = min(out[k], (some * times + plus).min())
    return out


def sketches(df: DataFrame, text: str, width: int = WIDTH, seed: int = 42, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add node, a digest of the shingle set, its size, and the words of its fingerprints; null and wordless texts are one node."""

    def start():
        def kernel(texts):
            sets = [shingle_set(x, width, seed) for x in texts]
            node = np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), 1) for x in sets], dtype=np.uint64).view(np.int64)
            flat = pa.array(tries.words_of(sets).view(np.int64).ravel())
            return [pa.array(node), pa.array([len(x) for x in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * tries.WORDS, pa.int32()), flat)]

        return kernel

    fields = [T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType()))]
    return append_columns(df, text, fields, start, drop)


def shingle_rows(df: DataFrame, text: str, width: int = WIDTH, seed: int = 42) -> DataFrame:
    """Replace the text by its shingle set and the parity of that."""

    def start():
        def kernel(texts):
            sets = [shingle_set(x, width, seed) for x in texts]
            return [[x.view(np.int64) for x in sets], [tries.parity_of(x) for x in sets]]

        return kernel

    return append_columns(df, text, [T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("parity", T.BinaryType())], start, (text,))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard of `least` or more."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}s")) for x in ("a", "b"))
    both = F.size(F.array_intersect("as", "bs"))
    return pairs.join(left, "a").join(right, "b").where(both >= least * (F.size("as") + F.size("bs") - both)).select("a", "b")


def bounds(sets: DataFrame, least: float) -> DataFrame:
    """node, parity, size, shared, common and rare, a bit for each of its rare shingles by its hash, of the nodes that may have a near copy."""
    of = sets.select("node", F.explode("shingles").alias("shingle"))
    few = of.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where((F.col("n") <= RARE) & F.col("first").isNotNull())
    # Of shingles that one node alone has, the greatest part, only their number is kept.
    own = few.where("n = 1").groupBy(F.col("first").alias("node")).agg(F.count(F.lit(1)).alias("own")).select("node", F.lit(None).cast("long").alias("shingle"), "own")
    some = of.join(few.where("n > 1").select("shingle"), "shingle").select("node", "shingle", F.lit(0).cast("long").alias("own"))
    bit = F.expr("shiftleft(1L, cast(pmod(shingle, 64) as int))")
    counts = own.unionByName(some).groupBy("node").agg(F.sum("own").alias("own"), F.count("shingle").alias("some"), F.bit_or(bit).alias("rare"))
    left = lambda c: (F.col("size") - F.coalesce(c, F.lit(0))).cast("int")
    known = sets.select("node", "parity", F.size("shingles").alias("size")).join(counts, "node", "left")
    known = known.select("node", "parity", "size", left(F.col("own")).alias("shared"), left(F.col("own") + F.col("some")).alias("common"), F.coalesce("rare", F.lit(0).cast("long")).alias("rare"))
    return known.where(tries.reaches(least, F.col("shared"), F.col("size"), F.col("shared")))


def _links(nodes: DataFrame, leads: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """node and component of all nodes that have a near copy; nodes: words and bounds, leads: nodes and neighbours (a, b)."""
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    end = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("shared").alias(f"shared_{x}"))
    may = tries.reaches(least, F.least("shared_a", "shared_b"), F.col("size_a"), F.col("size_b"))
    first = leads.select(*pair("a", "b")).distinct().join(end("a"), "a").join(end("b"), "b").where(may).select("a", "b")
    labels = _joined_labels(None, materialise(_verified(first, sets, least), "links"))
    name = lambda some, labels: materialise(some.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    fields = ["node", "component", "rare", "size", "shared", "common", "parity"]
    # The closest pair of every two components, and all pairs of those that it leaves apart.
    named = name(nodes, labels)
    found = tries.joined(named, fields, lambda a, b, depth, spent, same: tries.closest(a, b, depth, spent, same, least), "a long, b long, ca long, cb long, excess long")
    tried = materialise(found.groupBy("ca", "cb").agg(F.min(F.struct("excess", *pair("a", "b"))).alias("x")).select("ca", "cb", "x.a", "x.b"), "closest")
    links = materialise(_verified(tried.select("a", "b"), sets, least), "links")
    labels = _joined_labels(labels, links)
    now = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"now_{x}"))
    left = tried.join(links, ["a", "b"], "left_anti").join(now("a"), "a", "left").join(now("b"), "b", "left").where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b"))
    left = materialise(left.select(F.explode(F.array("ca", "cb")).alias("component")).distinct(), "left")
    some = materialise(named.join(left, "component").drop("component"), "some")
    found = tries.joined(name(some, labels), fields, lambda a, b, depth, spent, same: tries.apart(a, b, depth, spent, same, least), "a long, b long")
    rest = materialise(found.select(*pair("a", "b")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    return _joined_labels(labels, materialise(_verified(rest, sets, least), "links"))


def _joined_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node and component after more links (a, b): only the components that they join are looked at again."""
    if labels is None:
        return materialise(components(links), "labels")
    name = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = materialise(ends, "ends")
    roots = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("root"))
    both = labels.unionByName(ends.select(F.col("a").alias("node"), F.col("ca").alias("component"))).unionByName(ends.select(F.col("b").alias("node"), F.col("cb").alias("component"))).distinct()
    return materialise(both.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST, seed: int = 42) -> DataFrame:
    """One document of each component of near copies, as it was: that of the least key, then text hash; null keys last.

    Rows that agree in key and text hash are equal texts of one key, of which any one stays.
    """
    light = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("body"))
    marked = held(sketches(light, "body", width, seed, ("body",)))
    order = F.struct(F.col("key").isNull().alias("last"), "key", "tie")
    nodes = materialise(marked.groupBy("node").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("words").alias("words")), "nodes")
    met = materialise(tries.joined(nodes.select("node", "words"), ["node"], tries.led, "node long, leader long"), "met")
    placed = met.select("node").unionByName(met.select(F.col("leader").alias("node"))).distinct()
    wanted = nodes.join(placed, "node").select("node", F.col("first.key").alias("k"), F.col("first.tie").alias("t"))
    texts = light.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t"))).select("node", "body")
    sets = materialise(shingle_rows(texts, "body", width, seed).dropDuplicates(["node"]), "shingles")
    known = materialise(bounds(sets, least).join(nodes.select("node", "words"), "node"), "known")
    # Of the neighbours of a node those with the fewest rare shingles, as the origin of a family has, and one more.
    rank = F.struct((F.col("size") - F.col("common")).alias("few"), F.xxhash64("leader").alias("h"), "leader")
    ranked = met.join(known.select(F.col("node").alias("leader"), "size", "common"), "leader").groupBy("node").agg(F.min(rank)["leader"].alias("best"), F.max("leader").alias("most"), F.min("leader").alias("least"))
    leads = ranked.select(F.col("node").alias("a"), F.explode(F.array("best", "most", "least")).alias("b"))
    labels = _links(known, leads, sets, least)
    named = nodes.join(labels, "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    times = marked.groupBy("key", "tie").agg(F.count(F.lit(1)).alias("times"))
    survivors = materialise(first.join(times, first["key"].eqNullSafe(times["key"]) & (first["tie"] == times["tie"])).select(first["key"], first["tie"], "times"), "survivors")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("t"))
    kept = rows.join(survivors, F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("tie")))
    repeated = kept.where("times > 1").dropDuplicates(["k", "t"])
    return kept.where("times = 1").unionByName(repeated).select("row.*")
