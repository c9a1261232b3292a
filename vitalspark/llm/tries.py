"""Neighbours in SimHash tries, for a similarity at which one trie of 64 bits prunes nothing.

At a Jaccard of 0.8 about 15 % of the bits of two SimHash fingerprints differ. So a text has
`WORDS` words of 64 bits, and each of them, turned by every quarter, heads a trie of its own. A
trie is joined with itself as `simhash` does it, by pairs of nodes at the same depth that carry
the bits in which their prefixes differ: one at most in the first `FIRST` levels. The pairs of
leaves that are left are compared over the word and the next one, `BUDGET` of 128 bits at most.

The upper levels are joined as DataFrames, the subtrees below them walked inside a task. A
crowded node is split into parts, and its pairs into pairs of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .simhash import majority

#: Words of a text, turns of a word, levels that a trie is walked, bits that may differ there and in 128.
WORDS, TURNS, FIRST, FIRST_BUDGET, BUDGET = 7, 4, 16, 1, 32
#: Levels that are joined as DataFrames, records of a subtree before there are more, of a part of a crowded node.
DEPTH, SUBTREE, PART = 4, 1 << 18, 1 << 19
#: Bytes of a record that those two numbers are meant for, bits of a parity.
WIDTH, PARITY = 64, 1024
#: Candidate pairs compared at a time, of two nodes that are not walked further, members of a component held apart.
STEP, SMALL, LARGE = 1 << 18, 64, 256

_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, WORDS, dtype=np.uint64)
#: Fields of a record after word and tail, by their Spark types; binary is a parity.
_KINDS = {"bigint": (16, (">i8", ())), "int": (8, (">i4", ())), "binary": (PARITY // 4, (">u8", (PARITY // 64,)))}


def words_of(sets: list[np.ndarray]) -> np.ndarray:
    """The words of each set of hashes: a row a set, a SimHash a column; zeros for an empty set."""
    ends = np.cumsum([len(s) for s in sets])
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    out = np.empty((len(sets), WORDS), dtype=np.uint64)
    for k, seed in enumerate(_SEEDS):
        x = flat + seed
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(times)
        x ^= x >> np.uint64(31)
        out[:, k] = majority(np.split(x, ends[:-1]) if len(sets) else [])
    return out


def parity_of(found: np.ndarray) -> bytes:
    """For each residue of the hashes of a set, whether it has an odd number of members there."""
    counts = np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _ranges(a: np.ndarray, b: np.ndarray, depth: int, spent: int, same: bool):
    """Pairs of nodes of two sorted subtrees whose prefixes differ in few bits, walked to the leaves or to few words."""
    lo_a, hi_a = np.array([0]), np.array([len(a)])
    lo_b, hi_b = np.array([0]), np.array([len(b)])
    acc = np.array([spent])
    while len(acc):
        done = ((hi_a - lo_a) * (hi_b - lo_b) <= SMALL) | (depth >= FIRST)
        if done.any():
            yield lo_a[done], hi_a[done], lo_b[done], hi_b[done]
            lo_a, hi_a, lo_b, hi_b, acc = (x[~done] for x in (lo_a, hi_a, lo_b, hi_b, acc))
        bit = np.uint64(63 - depth)
        ones_a, ones_b = (np.concatenate(([0], np.cumsum((x >> bit & np.uint64(1)).astype(np.int64)))) for x in (a, b))
        mid_a, mid_b = hi_a - (ones_a[hi_a] - ones_a[lo_a]), hi_b - (ones_b[hi_b] - ones_b[lo_b])
        mirrored = (lo_a == lo_b) & same  # of the two mixed pairs of a node with itself one is enough
        children = [(lo_a, mid_a, lo_b, mid_b, acc), (mid_a, hi_a, mid_b, hi_b, acc), (lo_a, mid_a, mid_b, hi_b, acc + 1), (mid_a, hi_a, lo_b, mid_b, acc + 1 + FIRST * mirrored)]
        depth += 1
        kept = [[x[(p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= FIRST_BUDGET)] for x in p] for p in children]
        lo_a, hi_a, lo_b, hi_b, acc = (np.concatenate(x) for x in zip(*kept, strict=True))


def _near(a: np.ndarray, b: np.ndarray, lo_a, hi_a, lo_b, hi_b, same: bool):
    """Places (i, j) of the records within the budget in pairs of ranges, a bounded number compared at a time; for same, i is not j."""
    width = hi_b - lo_b
    sizes = (hi_a - lo_a) * width
    ends = np.cumsum(sizes)
    for at in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        flat = np.arange(at, min(at + STEP, int(ends[-1])))
        k = np.searchsorted(ends, flat, side="right")
        local = flat - (ends[k] - sizes[k])
        i, j = lo_a[k] + local // width[k], lo_b[k] + local % width[k]
        near = np.bitwise_count(a["word"][i] ^ b["word"][j]) + np.bitwise_count(a["tail"][i] ^ b["tail"][j]) <= BUDGET
        if same:
            near &= i != j
        if near.any():
            yield i[near], j[near]


def _members(lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges, the number of each and its places that are wanted."""
    owner = np.repeat(np.arange(len(lo)), hi - lo)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[owner]
    return owner[wanted[place]], place[wanted[place]]


def led(a: np.ndarray, b: np.ndarray, depth: int, spent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every record that has neighbours between two subtrees one of them: nodes and their leaders.

    In a large pair of leaves all are compared with the first of the other side, and only those
    that are not near it with the rest, so a family of g near copies costs g comparisons.
    """
    lead_a = np.full(len(a), -1)
    lead_b = lead_a if same else np.full(len(b), -1)

    def take(*ranges):
        for i, j in _near(a, b, *ranges, same):
            lead_a[i] = j
            lead_b[j] = i

    large = []
    for lo_a, hi_a, lo_b, hi_b in _ranges(a["word"], b["word"], depth, spent, same):
        some = (hi_a - lo_a) * (hi_b - lo_b) > SMALL
        take(lo_a[~some], hi_a[~some], lo_b[~some], hi_b[~some])
        lo_a, hi_a, lo_b, hi_b = (x[some] for x in (lo_a, hi_a, lo_b, hi_b))
        take(lo_a, hi_a, lo_b, lo_b + 1)
        take(lo_a, lo_a + 1, lo_b, hi_b)
        large.append((lo_a, hi_a, lo_b, hi_b))
    for lo_a, hi_a, lo_b, hi_b in large:
        owner, place = _members(lo_a, hi_a, lead_a < 0)
        take(place, place + 1, lo_b[owner], hi_b[owner])
        owner, place = _members(lo_b, hi_b, lead_b < 0)
        take(lo_a[owner], hi_a[owner], place, place + 1)
    of_a, of_b = np.flatnonzero(lead_a >= 0), np.flatnonzero(lead_b >= 0) if not same else np.empty(0, int)
    return np.concatenate((a["node"][of_a], b["node"][of_b])), np.concatenate((b["node"][lead_a[of_a]], a["node"][lead_b[of_b]]))


def reaches(least: float, common, size, other):
    """May sets of two sizes with at most so many common members have a Jaccard of `least`? A little is left for rounding."""
    return common >= least * (size + other - common) - 1e-6


def _excess(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Bits in which two parities differ, less what a Jaccard of `least` allows: above zero it is not reached.

    Every such bit is a member that one set alone has. Records without parities have none.
    """
    apart = -(x["size"][i].astype(np.int64) + y["size"][j]) * (1 - least) / (1 + least)
    if "parity" in x.dtype.names:
        for k in range(PARITY // 64):
            apart += np.bitwise_count(x["parity"][i, k] ^ y["parity"][j, k])
    return apart


def _different(a: np.ndarray, b: np.ndarray, depth: int, spent: int, same: bool, least: float):
    """Neighbours of different components between two subtrees that may have a Jaccard of `least`: nodes, their components, excess.

    Members of a large component are not compared with each other. `shared` bounds what two sets
    have in common, `common` what two have that share no rare member, as `rare` tells.
    """
    names, counts = np.unique(a["component"] if same else np.concatenate((a["component"], b["component"])), return_counts=True)
    large = names[counts >= LARGE]
    walks = []
    if same:
        left = a[~np.isin(a["component"], large)]
        walks.append((left, left, True))
        for k, name in enumerate(large):
            walks.append((a[a["component"] == name], a[~np.isin(a["component"], large[: k + 1])], False))
    else:
        walks.append((a[~np.isin(a["component"], large)], b, False))
        walks += [(a[a["component"] == name], b[b["component"] != name], False) for name in large]
    for x, y, twin in walks:
        for ranges in _ranges(x["word"], y["word"], depth, spent, twin):
            for i, j in _near(x, y, *ranges, twin):
                may = lambda kind, i=i, j=j, x=x, y=y: reaches(least, np.minimum(x[kind][i], y[kind][j]), x["size"][i], y["size"][j])
                kept = (x["component"][i] != y["component"][j]) & may("shared") & (may("common") | (x["rare"][i] & y["rare"][j] != 0))
                i, j = i[kept], j[kept]
                excess = _excess(x, y, i, j, least)
                i, j, excess = (v[excess <= 1e-6] for v in (i, j, excess))
                yield x["node"][i], y["node"][j], x["component"][i], y["component"][j], np.floor(excess).astype(np.int64)


def apart(a: np.ndarray, b: np.ndarray, depth: int, spent: int, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All neighbours of different components between two subtrees that may have a Jaccard of `least`."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)), *(x[:2] for x in _different(a, b, depth, spent, same, least))]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def closest(a: np.ndarray, b: np.ndarray, depth: int, spent: int, same: bool, least: float) -> tuple[np.ndarray, ...]:
    """Of what `apart` finds, the pair of least excess for every two components: nodes, components in order, excess."""
    best = (np.empty(0, np.int64),) * 5
    for p, q, of_p, of_q, excess in _different(a, b, depth, spent, same, least):
        both = zip(best, (p, q, np.minimum(of_p, of_q), np.maximum(of_p, of_q), excess), strict=True)
        best = [np.concatenate(x) for x in both]
        order = np.lexsort((best[4], best[3], best[2]))
        best = [x[order] for x in best]
        new = np.ones(len(order), bool)
        new[1:] = (best[2][1:] != best[2][:-1]) | (best[3][1:] != best[3][:-1])
        best = [x[new] for x in best]
    return tuple(best)


def joined(nodes: DataFrame, fields: list[str], kernel, schema: str) -> DataFrame:
    """The tries of `nodes` (words and fields, without nulls) joined with themselves: what kernel gives for each pair of subtrees.

    kernel(a, b, depth, spent, same) takes sorted records with word, tail and fields, and returns a pair of arrays.
    """
    n = nodes.count()
    kinds = dict(nodes.dtypes)
    record = np.dtype([("word", ">u8"), ("tail", ">u8"), *((f, *_KINDS[kinds[f]][1]) for f in fields)])
    times = -(-record.itemsize // WIDTH)
    depth = max(0, min(max(DEPTH, int(np.ceil(np.log2(max(1, n * times / SUBTREE))))), int(np.log2(max(1, n / 64))), FIRST))
    quarter = 64 // TURNS
    turned = lambda word, by: F.shiftleft(word, by).bitwiseOR(F.shiftrightunsigned(word, 64 - by)) if by else word
    word = lambda k: F.col("words")[k % WORDS]
    heads = [F.struct(F.lit(TURNS * k + t).alias("turn"), turned(word(k), quarter * t).alias("word"), word(k + 1).alias("tail")) for k in range(WORDS) for t in range(TURNS)]
    text = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    prefix: Column = F.shiftrightunsigned("word", 64 - depth).cast("int") if depth else F.lit(0)
    rows = nodes.select(F.explode(F.array(*heads)).alias("x"), F.concat(*[text(F.col(f), _KINDS[kinds[f]][0]) for f in fields]).alias("rest"))
    rows = rows.select("x.*", "rest").select("turn", prefix.alias("p"), "word", F.concat(text(F.col("word"), 16), text(F.col("tail"), 16), "rest").alias("record"))
    counts = rows.groupBy("turn", "p").agg(F.ceil(F.count(F.lit(1)) / F.lit(-(-PART // times))).cast("int").alias("parts"))
    packed = rows.join(counts, ["turn", "p"]).withColumn("i", F.pmod(F.xxhash64("record"), F.col("parts")).cast("int"))
    packed = materialise(packed.groupBy("turn", "p", "i").agg(F.unhex(F.array_join(F.collect_list("record"), "")).alias("a"), F.max("parts").alias("parts")), "subtrees")
    # Pairs of nodes whose prefixes differ in one bit at most, and of the parts of one node.
    each = packed.select("turn", "p", "i", "parts")
    tops = each.select("turn", F.col("p").alias("q"), F.col("parts").alias("other")).distinct()
    near = each.select("*", F.explode(F.array(*map(F.lit, [0, *(1 << k for k in range(depth))]))).alias("mask")).withColumn("q", F.col("p").bitwiseXOR(F.col("mask"))).where("p <= q")
    pairs = near.join(tops, ["turn", "q"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other") - 1))).where("p < q or i < j")
    right = packed.select("turn", F.col("p").alias("q"), F.col("i").alias("j"), F.col("a").alias("b"))
    across = pairs.join(packed.select("turn", "p", "i", "a"), ["turn", "p", "i"]).join(right, ["turn", "q", "j"]).select(F.bit_count("mask").alias("spent"), "a", "b")
    blocks = packed.select(F.lit(0).alias("spent"), "a", F.lit(None).cast("binary").alias("b")).unionByName(across)

    def run(batches):
        def read(buffer):
            rows = np.frombuffer(buffer, record).astype(record.newbyteorder("="))
            return rows[np.argsort(rows["word"])]

        names = [x.split()[0] for x in schema.split(",")]
        for batch in batches:
            for row in range(batch.num_rows):
                spent, a, b = batch.column(0)[row].as_py(), batch.column(1)[row].as_buffer(), batch.column(2)[row].as_buffer()
                left = read(a)
                found = kernel(left, left if b is None else read(b), depth, spent, b is None)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, dtype=np.int64)) for x in found], names=names)

    return blocks.mapInArrow(run, schema)
