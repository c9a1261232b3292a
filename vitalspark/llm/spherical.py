"""Near-duplicate embeddings by spherical-cap filters.

Filters are caps around the codewords of random product codes: after a fixed random rotation the
space is cut into blocks, each block has its own random unit codewords, and a filter is one
codeword a block. A vector passes the filters that exceed a threshold of its own, lowered until it
passes PASSED of them, in each of ROTATIONS codes. Since the product with a filter's direction is a sum over blocks,
these are listed best first from the ranked codewords of the blocks, without looking at the others:
a pair of ranks (i, j) can be among the best L only if (i + 1) (j + 1) <= L.

Vectors of a label that share a mean would crowd into the caps around it, so filters are laid around
what is left of a vector without its label's mean, but for vectors so near to the mean that they
link with it. Vectors of one label that pass a common filter are candidates; the cosine of the
vectors themselves decides. Equal vectors of a label are one class, compared once. Filters carry each vector
in a byte a component, with the length of the rounding error: candidates surely below the bound end
where they meet, those surely above it are links at once, and only the rest are looked up for the
exact cosine in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

#: Blocks of a product code; codes; filters that a vector passes in each; members of a filter compared in one task.
BLOCKS, ROTATIONS, PASSED, PART = 2, 2, 20, 256
#: Vectors of a filter aimed at; cosine, without the means, of pairs that caps have to be wide enough for.
MEMBERS, REACH = 16, 0.79
#: Distance of a unit vector from its label's mean under which it goes by itself.
NEAR = 0.5
#: Numbers that the listing of filters holds at a time.
STEP = 1 << 22


def cap_share(dimensions: int, cosine: float) -> float:
    """Share of a sphere that is within an angle of a point."""
    if dimensions < 2:
        return 0.5
    angle = np.linspace(0, math.pi, 20_001)
    density = np.sin(angle) ** (dimensions - 2) if dimensions > 2 else np.ones_like(angle)
    return float(density[angle <= math.acos(cosine)].sum() / density.sum())


@dataclass
class Code:
    """Rotations, and for each the codewords of its blocks."""

    rotations: list[np.ndarray]
    words: list[list[np.ndarray]]

    @staticmethod
    def of(dimensions: int, n: int, seed: int = 11) -> Code:
        """Codes for n vectors: about MEMBERS a filter where they are spread evenly, so codewords grow with the root of n.

        In a few dimensions there are at most so many filters that the best of a vector reach as far
        as a pair may lie apart.
        """
        rng = np.random.default_rng(seed)
        # In a few dimensions blocks of codewords would leave gaps: one block instead.
        blocks = BLOCKS if dimensions >= 8 * BLOCKS else 1
        wanted = min(PASSED * max(1, n) / MEMBERS, PASSED / max(cap_share(dimensions, REACH), 1e-12))
        each = max(2, math.ceil(wanted ** (1 / blocks)))
        made = Code([], [])
        for _ in range(ROTATIONS):
            made.rotations.append(np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0])
            words = []
            for part in np.array_split(np.arange(dimensions), blocks):
                w = rng.standard_normal((each, len(part)))
                words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
            made.words.append(words)
        return made

    def passed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and filter numbers of the filters that unit vectors pass: the best PASSED of each code."""
        if not len(vectors):
            return (np.zeros(0, dtype=np.int64),) * 2
        step = max(1, STEP // max(w.shape[0] for words in self.words for w in words))
        rows, filters = [], []
        for at in range(0, len(vectors), step):
            part = vectors[at : at + step]
            for k, (rotation, words) in enumerate(zip(self.rotations, self.words, strict=True)):
                found = _best(part @ rotation, words) * len(self.words) + k
                rows.append(np.repeat(np.arange(at, at + len(part)), found.shape[1]))
                filters.append(found.ravel())
        return np.concatenate(rows), np.concatenate(filters)


def _best(turned: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Numbers of the filters with the largest products, PASSED a row or all if there are fewer."""
    cuts = np.cumsum([0] + [w.shape[1] for w in words])
    ranked = []
    for a, b, w in zip(cuts[:-1], cuts[1:], words, strict=True):
        product = turned[:, a:b] @ w.T
        top = min(PASSED, product.shape[1])
        some = np.argpartition(-product, top - 1, axis=1)[:, :top]
        values = np.take_along_axis(product, some, axis=1)
        order = np.argsort(-values, axis=1)
        ranked.append((np.take_along_axis(some, order, axis=1), np.take_along_axis(values, order, axis=1)))
    numbers, sums = ranked[0]
    for (more, values), w in zip(ranked[1:], words[1:], strict=True):
        i, j = np.nonzero(np.outer(np.arange(1, numbers.shape[1] + 1), np.arange(1, more.shape[1] + 1)) <= PASSED)
        every = sums[:, i] + values[:, j]
        top = min(PASSED, every.shape[1])
        kept = np.argsort(-every, axis=1, kind="stable")[:, :top]
        numbers = numbers[np.arange(len(every))[:, None], i[kept]] * w.shape[0] + more[np.arange(len(every))[:, None], j[kept]]
        sums = np.take_along_axis(every, kept, axis=1)
    return numbers


def directions(units: np.ndarray, means: np.ndarray, least_cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and directions of the vectors in two sets of filters: without their means, and as they are.

    Vectors nearer than NEAR to their mean go by themselves, as little is left of them and that points anywhere;
    those further than NEAR less the longest distance of a linked pair go by what is left. Two linked
    vectors are both in the one set or both in the other.
    """
    rest = units - means
    length = np.linalg.norm(rest, axis=1)
    far, near = np.flatnonzero(length > NEAR - math.sqrt(2 - 2 * least_cosine) - 1e-9), np.flatnonzero(length < NEAR)
    return [(far, rest[far] / np.maximum(length[far], 1e-12)[:, None]), (near, units[near])]


def classes(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """label, vector (double), least (its smallest key), size: one row for equal vectors of a label.

    Vectors that can link with nothing (null label, null, empty, zero, or with null or non-finite
    components) are left out.
    """
    doubles = F.transform(F.col(embedding), lambda x: x.cast("double"))
    usable = F.col(label).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(usable).select(F.col(label).alias("label"), doubles.alias("vector"), F.col(key).alias("key")).where(finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("label", "vector").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("size"))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled first so that no square overflows or vanishes."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def rounded(rows: np.ndarray) -> list[bytes]:
    """Unit rows as bytes: the step and the length of the error as float32, then a signed byte a component."""
    step = (np.abs(rows).max(axis=1) / 127).astype(np.float32)
    whole = np.rint(rows / step[:, None]).clip(-127, 127).astype(np.int8)
    error = np.sqrt(((rows - whole * step[:, None].astype(float)) ** 2).sum(axis=1)) * 1.0001 + 1e-7
    head = np.stack([step, error.astype(np.float32)], axis=1)
    return [h.tobytes() + w.tobytes() for h, w in zip(head, whole, strict=True)]


def restored(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rounded rows and the lengths of their errors."""
    data = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    head = np.ascontiguousarray(data[:, :8]).view("<f4")
    return np.ascontiguousarray(data[:, 8:]).view(np.int8).astype(np.float32) * head[:, :1], head[:, 1].astype(float)


def label_means(rows: DataFrame, width: int) -> DataFrame:
    """l, n and mean of each label: how many classes it has and the mean of their unit vectors. rows: label, vector, of one width."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                matrix, (labels, which) = unit(np.array(part.column(1).to_pylist())), _numbered(part.column(0))
                total = np.zeros((len(labels), width))
                np.add.at(total, which, matrix)
                counts = np.bincount(which, minlength=len(labels))
                yield pa.RecordBatch.from_arrays([labels, pa.array(counts), pa.array(list(total), pa.list_(pa.float64()))], names=["label", "n", "total"])

    sums = rows.select("label", "vector").mapInArrow(run, f"label {kind}, n long, total array<double>")
    found = sums.groupBy(F.col("label").alias("l")).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    return found.select("l", "n", F.transform("total", lambda x: x / F.col("n")).alias("mean"))


def _numbered(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values of a column and each row's place among them."""
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def filtered(rows: DataFrame, codes: dict[int, Code], least_cosine: float) -> DataFrame:
    """(label, filter, class, rough) of every filter that a class passes, by the code of its level. rows: label, class, vector, level, mean."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)  # codewords: the root of a label's vectors, a code a level
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                matrix, levels = unit(np.array(part.column(2).to_pylist())), part.column(3).to_numpy()
                roughs = pa.array(rounded(matrix), pa.binary())
                for kind_of, (rows_of, ways) in enumerate(directions(matrix, np.array(part.column(4).to_pylist()), least_cosine)):
                    for level in np.unique(levels[rows_of]).tolist():
                        some = np.flatnonzero(levels[rows_of] == level)
                        which, filters = own[level].passed(ways[some])
                        take = pa.array(rows_of[some][which])
                        yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(filters * 2 + kind_of), part.column(1).take(take), roughs.take(take)], names=["label", "filter", "class", "rough"])

    return rows.select("label", "class", "vector", "level", "mean").mapInArrow(run, f"label {kind}, filter long, class long, rough binary")


def meetings(a: list[int], rough_a: list[bytes], b: list[int], rough_b: list[bytes], bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two parts whose cosine may reach the bound, smaller class first, and whether it surely does."""
    (u, eu), (v, ev) = restored(rough_a), restored(rough_b)
    slack = (1 + eu)[:, None] * ev[None, :] + eu[:, None] * (1 + ev)[None, :] + eu[:, None] * ev[None, :] + 1e-5
    products = u @ v.T
    i, j = np.nonzero(products >= bound - slack)
    x, y = np.array(a, dtype=np.int64)[i], np.array(b, dtype=np.int64)[j]
    sure = products[i, j] >= bound + slack[i, j]
    x, y = np.minimum(x, y), np.maximum(x, y)
    pairs, first = np.unique(np.stack([x, y], axis=1)[x < y], axis=0, return_index=True)
    return pairs[:, 0], pairs[:, 1], sure[x < y][first]


def verified(rows: DataFrame, members: DataFrame, least_cosine: float) -> DataFrame:
    """Linked classes (a, b), a < b: candidates of common filters whose cosine is at least the bound.

    A filter's members are dealt to parts of about PART, and every two parts of a filter meet in a
    row of their own, so a crowded filter is spread over many tasks and none of its pairs is lost.
    """
    crowds = members.groupBy("label", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowds = crowds.select("label", "filter", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    dealt = members.join(crowds, ["label", "filter"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    gathered = dealt.groupBy("label", "filter", "part").agg(F.collect_list(F.struct("class", "rough")).alias("held"), F.first("parts").alias("parts"))
    packs = materialise(gathered.select("label", "filter", "part", "parts", F.col("held.class").alias("classes"), F.col("held.rough").alias("roughs")), "packs")
    left = packs.select("label", "filter", F.col("part").alias("i"), F.col("classes").alias("a"), F.col("roughs").alias("ra"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"))
    right = packs.select("label", "filter", F.col("part").alias("j"), F.col("classes").alias("b"), F.col("roughs").alias("rb"))
    blocks = left.join(right, ["label", "filter", "j"]).select("a", "ra", "b", "rb")

    def meet(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, sure = meetings(*(batch.column(c)[k].as_py() for c in range(4)), least_cosine)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(sure)], names=["x", "y", "sure"])

    pairs = materialise(blocks.mapInArrow(meet, "x long, y long, sure boolean").groupBy("x", "y").agg(F.max("sure").alias("sure")), "pairs")
    one = rows.select(F.col("class").alias("x"), F.col("vector").alias("u"))
    other = rows.select(F.col("class").alias("y"), F.col("vector").alias("v"))
    joined = pairs.where(~F.col("sure")).select("x", "y").join(one, "x").join(other, "y")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                u, v = np.array(part.column(2).to_pylist()), np.array(part.column(3).to_pylist())
                near = pa.array(cosines(u, v) >= least_cosine)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(near), part.column(1).filter(near)], names=["a", "b"])

    exact = joined.select("x", "y", "u", "v").mapInArrow(run, "a long, b long")
    return pairs.where("sure").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(exact)


def cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, scaled first so that no square overflows or vanishes."""
    u, v = u / np.abs(u).max(axis=1, keepdims=True), v / np.abs(v).max(axis=1, keepdims=True)
    return (u * v).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1))


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.93, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row a vector: key, n_links, component_id (the smallest key reachable), kept.

    Only vectors of one label, not null, and of one length are compared. Null, empty and zero
    vectors and those with null or non-finite components link with nothing and are their own
    components. Repeated rows are vectors of their own, equal to each other. A null key never names
    a component but its own, and is kept only if it links with nothing. An empty table gives an
    empty one.
    """
    # Classes are numbered, not named by a key, which repeated keys would share.
    found = classes(vectors, key, embedding, label).withColumns({"class": F.monotonically_increasing_id(), "width": F.size("vector")})
    found = materialise(found, "classes")
    # A label's code depends on how many classes it has, by powers of four; a row a width.
    level = F.floor(F.log2(F.col("n").cast("double")) / 2).cast("int")
    links = None
    for width in sorted(r["width"] for r in found.select("width").distinct().collect()):
        own = found.where(F.col("width") == width)
        labels = materialise(label_means(own, width).withColumn("level", level), "labels")
        levels = [r["level"] for r in labels.select("level").distinct().collect()]  # a row a power of four
        placed = own.join(labels.select("l", "level", "mean"), F.col("label") == F.col("l")).drop("l")
        members = materialise(filtered(placed, {k: Code.of(width, 4**k * 2) for k in levels}, least_cosine), "filters")
        own = verified(own, members, least_cosine)
        links = own if links is None else links.unionByName(own)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a long, b long")
    links = materialise(links, "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = found.select(F.col("class").alias("b"), "size")
    linked = both.join(sizes, "b").groupBy("a").agg(F.sum("size").alias("others"))
    parts = components(links).select(F.col("node").alias("class"), "component")
    named = found.join(linked, found["class"] == linked["a"], "left").join(parts, "class", "left")
    named = named.select("label", "vector", "least", "component", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = materialise(named.join(roots, "root").select(F.col("label").alias("l"), F.col("vector").alias("v"), "n_links", "component_id"), "named")
    doubles = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), doubles.alias("vector"))
    joined = rows.join(table, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left")
    component = F.coalesce("component_id", "key")
    return joined.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.col("component_id").isNull()).alias("kept")
    )
