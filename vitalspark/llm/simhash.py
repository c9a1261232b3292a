"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The trie is walked as pairs of nodes at the same depth: a pair carries the bits in which its
prefixes differ, and goes no further once they exceed the budget. Two fingerprints at most four
bits apart differ in one bit at most in one of their thirds, so the walk is made three times, with
each third first, and allows one bit within the first 21 levels and four in all. So a node of the
upper levels meets as many others as it has levels, and not their square.

The upper levels are walked as DataFrame joins on prefixes, the subtrees below them as vectors
inside a task. A crowded node is split into parts of bounded size, and its pairs into pairs of
parts. Each task returns a spanning forest of the links that it finds, not the links, so a dense
group of n fingerprints gives n - 1 rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, components, held, materialise

#: Differing bits that link, fingerprints of a subtree, fingerprints of a part of a crowded node.
BUDGET, SUBTREE, PART = 4, 2048, 4096
#: Candidate pairs compared at a time; turns of a fingerprint, levels of the part that each brings to the top.
STEP, TURNS, FIRST = 1 << 20, 3, 21


def hashes(text: str, width: int, seed: int) -> list[int]:
    """XXH64 of each shingle of a text: ASCII lower case, words between ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    row, ends, at = b" ".join(words), [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-width]]
    digest = xxhash.xxh64_intdigest
    return [digest(row[s:e], seed) for s, e in zip(starts, ends[width - 1 :], strict=True)]


def majority(rows: list[np.ndarray]) -> np.ndarray:
    """For each row of hashes the word whose bits are set in over half of them; 0 for no hashes.

    Bits are counted in byte lanes: eight shifts leave each bit in a byte of its own, and at most
    255 hashes are added before the lanes are widened.
    """
    out = np.zeros(len(rows), dtype=np.uint64)
    kept = [i for i, r in enumerate(rows) if len(r)]
    if not kept:
        return out
    sizes = np.array([len(rows[i]) for i in kept])
    flat = np.concatenate([rows[i] for i in kept])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    runs = -(-sizes // 255)
    owner = np.repeat(np.arange(len(kept)), runs)
    run_first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    starts = first[owner] + 255 * (np.arange(len(owner)) - run_first[owner])
    counts = np.empty((len(kept), 64), dtype=np.int64)
    for shift in range(8):
        lanes = np.add.reduceat(flat >> np.uint64(shift) & np.uint64(0x0101010101010101), starts)
        wide = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, shift::8] = np.add.reduceat(wide, run_first, axis=0)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[kept] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, text: str = "text", width: int = 4, seed: int = 42, name: str = "fingerprint", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the fingerprint as a long of the same 64 bits; null and wordless texts have 0."""

    def start():
        def kernel(texts):
            rows = [np.array(hashes(x, width, seed), dtype=np.uint64) for x in texts]
            return [pa.array(majority(rows).view(np.int64))]

        return kernel

    return append_columns(df, text, [T.StructField(name, T.LongType())], start, drop)


def walk(a: np.ndarray, b: np.ndarray, depth: int, spent: int, budget: int, first_budget: int, same: bool):
    """Pairs (i, j) of two sorted subtrees whose words differ in at most `budget` bits.

    depth: bits that each side shares within itself; spent: bits in which the two prefixes differ.
    Yields arrays of positions; for same, only i < j.
    """
    lo_a, hi_a = np.array([0]), np.array([len(a)])
    lo_b, hi_b = np.array([0]), np.array([len(b)])
    acc = np.array([spent])
    while len(acc):
        small = (hi_a - lo_a) * (hi_b - lo_b) <= 64
        if depth == 64:
            small[:] = True
        if small.any():
            yield from _compare(a, b, lo_a[small], hi_a[small], lo_b[small], hi_b[small], budget, same)
            lo_a, hi_a, lo_b, hi_b, acc = (x[~small] for x in (lo_a, hi_a, lo_b, hi_b, acc))
        if not len(acc):
            return
        shift = np.uint64(63 - depth)
        ones_a = np.concatenate(([0], np.cumsum((a >> shift & np.uint64(1)).astype(np.int64))))
        ones_b = np.concatenate(([0], np.cumsum((b >> shift & np.uint64(1)).astype(np.int64))))
        mid_a, mid_b = hi_a - (ones_a[hi_a] - ones_a[lo_a]), hi_b - (ones_b[hi_b] - ones_b[lo_b])
        twin = (lo_a == lo_b) & same
        parts = [
            (lo_a, mid_a, lo_b, mid_b, acc, None),
            (mid_a, hi_a, mid_b, hi_b, acc, None),
            (lo_a, mid_a, mid_b, hi_b, acc + 1, None),
            (mid_a, hi_a, lo_b, mid_b, acc + 1, ~twin),
        ]
        depth += 1
        allowed = first_budget if depth <= FIRST else budget
        kept = []
        for la, ha, lb, hb, c, mask in parts:
            ok = (ha > la) & (hb > lb) & (c <= allowed)
            if mask is not None:
                ok &= mask
            kept.append((la[ok], ha[ok], lb[ok], hb[ok], c[ok]))
        lo_a, hi_a, lo_b, hi_b, acc = (np.concatenate(x) for x in zip(*kept, strict=True))


def _compare(a, b, lo_a, hi_a, lo_b, hi_b, budget, same):
    """Compare all words of each pair of ranges, a bounded number at a time."""
    width = hi_b - lo_b
    sizes = (hi_a - lo_a) * width
    ends = np.cumsum(sizes)
    for at in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        flat = np.arange(at, min(at + STEP, int(ends[-1])))
        k = np.searchsorted(ends, flat, side="right")
        local = flat - (ends[k] - sizes[k])
        i, j = lo_a[k] + local // width[k], lo_b[k] + local % width[k]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]


class Forest:
    """Smallest-member labels of items joined by arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.label[i], self.label[j]
            apart = x != y
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def subtree_links(a: bytes, b: bytes, depth: int, spent: int, same: bool, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two subtrees: members and their roots."""
    left = np.sort(np.frombuffer(a, dtype=">u8").astype(np.uint64))
    right = left if same else np.sort(np.frombuffer(b, dtype=">u8").astype(np.uint64))
    offset = 0 if same else len(left)
    forest = Forest(len(left) + (0 if same else len(right)))
    for i, j in walk(left, right, depth, spent, budget, budget // TURNS, same):
        forest.join(i, j + offset)
    words = left if same else np.concatenate((left, right))
    moved = np.flatnonzero(forest.label != np.arange(len(words)))
    return words[moved], words[forest.label[moved]]


def trie_links(words: DataFrame, column: str = "fingerprint", budget: int = BUDGET, subtree: int = SUBTREE) -> DataFrame:
    """Links (a, b) that connect all distinct words at most `budget` bits apart.

    words: distinct longs in `column`, without nulls. Every two words within the budget end up in one component;
    words beyond it are never linked themselves. Empty tables and single words give no rows.
    """
    n = words.count()
    depth = max(0, min(FIRST, int(np.ceil(np.log2(max(1, n / subtree))))))
    rotated = lambda by: F.shiftleft("raw", by).bitwiseOR(F.shiftrightunsigned("raw", 64 - by)) if by else F.col("raw")
    turned = words.select(F.col(column).alias("raw")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), rotated(FIRST * k).alias("word")) for k in range(TURNS)])).alias("x")).select("x.*")
    prefix = F.shiftrightunsigned("word", 64 - depth).cast("int") if depth else F.lit(0)
    turned = turned.withColumn("node", prefix)
    counts = turned.groupBy("turn", "node").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts"))
    packed = (
        turned.join(counts, ["turn", "node"])
        .withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        .groupBy("turn", "node", "part")
        .agg(F.unhex(F.array_join(F.collect_list(F.lpad(F.hex("word"), 16, "0")), "")).alias("words"))
    )
    packed = materialise(packed, "subtrees")
    # Node pairs of the upper levels: prefixes that differ in a third of the budget at most.
    masks = [sum(1 << i for i in bits) for k in range(budget // TURNS + 1) for bits in combinations(range(depth), k)]
    nodes = packed.groupBy("turn", "node").agg(F.max("part").alias("top"))
    near = nodes.select("turn", F.col("node").alias("p"), F.col("top").alias("top_p"), F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("q", F.col("p").bitwiseXOR(F.col("mask"))).where("p <= q")
    other = nodes.select("turn", F.col("node").alias("q"), F.col("top").alias("top_q"))
    pairs = (
        near.join(other, ["turn", "q"])
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("top_p"))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("top_q"))))
        .where("p < q or i <= j")
        .select("turn", "p", "i", "q", "j", F.bit_count("mask").alias("spent"))
    )
    left = packed.select("turn", F.col("node").alias("p"), F.col("part").alias("i"), F.col("words").alias("a"))
    right = packed.select("turn", F.col("node").alias("q"), F.col("part").alias("j"), F.col("words").alias("b"))
    joined = pairs.join(left, ["turn", "p", "i"]).join(right, ["turn", "q", "j"])
    blocks = joined.select("turn", "spent", F.expr("p = q and i = j").alias("same"), F.expr("p = q").alias("own"), "a", "b")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                turn, spent, same = (batch.column(k)[row].as_py() for k in range(3))
                a, b = (batch.column(k)[row].as_buffer() for k in (4, 5))
                x, y = subtree_links(a, b, depth, spent, same, budget)
                if turn:
                    by = np.uint64(FIRST * turn)
                    x, y = (v >> by | v << np.uint64(64) - by for v in (x, y))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, budget: int = BUDGET) -> DataFrame:
    """One row a document: key, fingerprint long, component_id (the smallest key reachable).

    Null texts count as empty; wordless texts have fingerprint 0 and link like any other. Repeated
    rows and repeated keys stay; a null key never is a component's name unless all its keys are
    null. An empty table gives an empty one.
    """
    marked = held(fingerprints(df.select(F.col(key), F.col(text)), text, width, seed, "fingerprint", drop=(text,)))
    return marked.join(_names(marked, key, budget), "fingerprint", "left").select(key, "fingerprint", "component_id")


def _names(marked: DataFrame, key: str, budget: int) -> DataFrame:
    """fingerprint and component_id, the least key of its component, of every fingerprint."""
    words = materialise(marked.groupBy("fingerprint").agg(F.min(key).alias("least")), "words")
    found = components(trie_links(words, "fingerprint", budget))
    named = words.join(found, words["fingerprint"] == found["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min("fingerprint").alias("component"))
    return materialise(named.join(roots, "root").select("fingerprint", "component_id", "component"), "names")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, budget: int = BUDGET) -> DataFrame:
    """One document of each component, as it was: that of the least key, then text hash; null keys last.

    The survivors are found among (key, text hash) pairs; rows that agree in both are equal texts
    of one key, of which any one stays.
    """
    light = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("body"))
    marked = held(fingerprints(light, "body", width, seed, "fingerprint", drop=("body",)))
    named = marked.join(_names(marked, "key", budget), "fingerprint")
    order = F.struct(F.col("key").isNull().alias("last"), "key", "tie")
    first = named.groupBy("component").agg(F.min(order).alias("first")).select("first.*")
    times = marked.groupBy("key", "tie").agg(F.count(F.lit(1)).alias("times"))
    survivors = materialise(first.join(times, first["key"].eqNullSafe(times["key"]) & (first["tie"] == times["tie"])).select(first["key"], first["tie"], "times"), "survivors")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("t"))
    kept = rows.join(survivors, F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("tie")))
    repeated = kept.where("times > 1").dropDuplicates(["k", "t"])
    return kept.where("times = 1").unionByName(repeated).select("row.*")
