"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms are counted over the whole corpus, once a document.
2. Benchmark texts are cut into passages. For each block of `BLOCK` passages a randomised SVD of
   their TF-IDF rows gives a latent basis: a seeded Gaussian sketch of the rows, its orthonormal
   range, and the grouped sum of the rows' images under it, all as Spark jobs; only matrices whose
   size the block bounds come to the driver. A larger benchmark has more blocks, not larger ones.
3. Every document is cut into overlapping windows over its whole length. A window is folded into
   the basis; the length of its projection bounds its cosine with every passage, so most windows
   end there, and the others are compared with all passages of the block.
4. A candidate has to share a longest common subsequence with the passage. Above `SURE` that is
   enough; between `LEAST` and `SURE` it is a paraphrase, and the passage's answer, its closing
   words, has to be there too.

Terms of many documents tell nothing in the latent space, so passages that have little weight
beside them are candidates by their words instead: a region has to hold `LEAST` of them, which a
common subsequence of that length implies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialise, slices, texts_of

#: Bytes of text that a kernel holds at a time: its arrays take some forty bytes for each.
PIECE = 1 << 19
#: Bits of a hashed term; words of a half window; passages of a block; blocks of one reading of the corpus.
BITS, HALF, BLOCK, BLOCKS = 18, 32, 256, 8
#: Least cosine of a candidate; least and sure share of a passage in the common subsequence.
COSINE, LEAST, SURE = 0.12, 0.6, 0.8
#: Terms in more than this share of documents tell nothing; energy that a basis keeps; answer words.
COMMON, ENERGY, ANSWER = 0.2, 0.98, 4
#: Times the least cosine that a passage reaches in a window of uncommon words, or it is searched for by its words.
PLAIN = 2.0

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up = np.cumprod(np.full(n + 1, _ODD, dtype=np.uint64)) * inverse * inverse
    down = np.cumprod(np.full(n + 1, inverse, dtype=np.uint64)) * _ODD * _ODD
    return up, down


class Tokens:
    """Hashed terms of many texts at once: words between ASCII white space, ASCII lower case.

    A word's hash is its polynomial in the powers of an odd number, from prefix sums modulo 2^64.
    """

    def __init__(self):
        self.up, self.down = _powers(0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Terms, text numbers, starts and ends of all words, and the bytes that these are places in."""
        parts = [x.encode() for x in texts]
        data = b"\n".join(parts).lower() + b"\n"
        raw = np.frombuffer(data, dtype=np.uint8)
        if len(raw) >= len(self.up):
            self.up, self.down = _powers(len(raw) + len(raw) // 8)
        space = _SPACE[raw]
        edges = np.diff(space.view(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        ends = ends[len(ends) - len(starts) :] if len(starts) else ends[:0]
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])))
        value = (sums[ends] - sums[starts]) * self.down[starts]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        terms = (value >> np.uint64(64 - BITS)).astype(np.int64)
        bounds = np.cumsum([len(x) + 1 for x in parts])
        return terms, np.searchsorted(bounds, starts, side="right"), starts, ends, data


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each hashed term is, and the number of documents.

    2^BITS counts come to the driver, whatever the corpus.
    """

    def count(batches):
        tokens = Tokens()
        total, rows = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                texts = texts_of(part, "text")
                terms, owner, *_ = tokens(texts)
                total += np.bincount(np.unique(owner << BITS | terms) & ((1 << BITS) - 1), minlength=1 << BITS)
                rows += len(texts)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], rows))], names=["term", "n"])

    given = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = given.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << BITS, dtype=np.int64)
    terms, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    table[terms[terms >= 0]] = n[terms >= 0]
    return table, int(n[terms < 0].sum())


@dataclass
class Passage:
    item: int | None
    words: list[bytes]
    answer: list[bytes]


@dataclass
class Basis:
    """A block of passages in its latent space; `row` gives a term's row of `fold`, -1 for none."""

    passages: list[Passage]
    row: np.ndarray
    fold: np.ndarray
    latent: np.ndarray


def passages_of(item, text: str | None) -> list[Passage]:
    """Passages of at most two half windows, each with its closing words as the answer."""
    words = (text or "").encode().lower().split()
    cuts = [words[i : i + 2 * HALF] for i in range(0, len(words), 2 * HALF)]
    if len(cuts) > 1 and len(cuts[-1]) < HALF:
        cuts[-1] = words[-2 * HALF :]
    return [Passage(item, c, c[-ANSWER:]) for c in cuts if len(c) >= ANSWER]


def tfidf(words: list[bytes], idf: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a unit row; common terms weigh nothing."""
    terms, *_ = tokens([b" ".join(words).decode(errors="replace")])
    seen, n = np.unique(terms, return_counts=True)
    weight = n * idf[seen]
    norm = np.sqrt((weight**2).sum())
    return seen, weight / norm if norm else weight


def latent_basis(block: DataFrame, idf: np.ndarray, rank: int = BLOCK, oversampling: int = 16, seed: int = 7) -> Basis:
    """Randomised SVD of the TF-IDF rows of a block of passages (item long, words array<binary>, answer array<binary>, at)."""
    size = rank + oversampling

    def rows_of(batch, tokens):
        for at, words in zip(batch.column(batch.schema.get_field_index("at")).to_pylist(), batch.column(batch.schema.get_field_index("words")).to_pylist(), strict=True):
            yield at, *tfidf(words, idf, tokens)

    def gaussian(terms):
        return np.stack([np.random.default_rng([seed, int(t)]).standard_normal(size) for t in terms]) if len(terms) else np.zeros((0, size))

    def sketch(batches):
        tokens = Tokens()
        for batch in batches:
            made = [(at, (weights @ gaussian(terms)).tolist()) for at, terms, weights in rows_of(batch, tokens)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["at", "y"])

    made = sorted(block.mapInArrow(sketch, "at long, y array<double>").collect())  # BLOCK rows at most
    if not made:  # the hash dealt no passage to this block
        return Basis([], np.full(1 << BITS, -1, dtype=np.int32), np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0), dtype=np.float32))
    places = {r["at"]: i for i, r in enumerate(made)}
    u, s, _ = np.linalg.svd(np.array([r["y"] for r in made]), full_matrices=False)
    q = u[:, s > 1e-9 * max(s.max(initial=0.0), 1e-300)]

    def images(batches):
        tokens = Tokens()
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            for at, terms, weights in rows_of(batch, tokens):
                for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                    if w:
                        found[t] = found.get(t, 0.0) + w * q[places[at]]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tolist() for x in found.values()], pa.list_(pa.float64()))], names=["term", "b"])

    width = q.shape[1]
    summed = block.mapInArrow(images, "term long, b array<double>").groupBy("term").agg(F.array(*[F.sum(F.col("b")[i]) for i in range(width)]).alias("b")) if width else None
    found = sorted(summed.collect()) if width else []  # terms of BLOCK passages at most
    terms = np.array([r["term"] for r in found], dtype=np.int64)
    b = np.array([r["b"] for r in found]).reshape(len(found), width)
    _, values, turn = np.linalg.svd(b, full_matrices=False) if len(found) else (None, np.zeros(0), np.zeros((0, width)))
    energy = np.cumsum(values**2)
    kept = int(np.searchsorted(energy, ENERGY * energy[-1]) + 1) if len(energy) else 0
    v = b @ turn[:kept].T / values[:kept] if kept else np.zeros((len(found), 0))
    table = np.full(1 << BITS, -1, dtype=np.int32)
    table[terms] = np.arange(len(terms))
    tokens = Tokens()
    passages, latent = [], []
    for r in sorted(block.collect(), key=lambda r: r["at"]):
        seen, weights = tfidf([bytes(w) for w in r["words"]], idf, tokens)
        inside = table[seen] >= 0
        latent.append(weights[inside] @ v[table[seen[inside]]])
        passages.append(Passage(r["item"], [bytes(w) for w in r["words"]], [bytes(w) for w in r["answer"]]))
    return Basis(passages, table, (v * idf[terms][:, None]).astype(np.float32), np.array(latent, dtype=np.float32).reshape(len(passages), kept))


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, with a row of the table as the bits of one number."""
    masks: dict[bytes, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & masks.get(x, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class PlainWords:
    """Passages of a block whose rare terms weigh under `plain` together, searched for by all their words."""

    def __init__(self, passages: list[Passage], rare: np.ndarray, plain: float, least: float, tokens: Tokens):
        counted = [(p, *np.unique(tokens([b" ".join(p.words).decode(errors="replace")])[0], return_counts=True)) for p in passages]
        kept = [x for x in counted if ((x[2] * rare[x[1]]) ** 2).sum() < plain]
        self.passages = [x[0] for x in kept]
        known = np.unique(np.concatenate([x[1] for x in kept])) if kept else np.zeros(0, dtype=np.int64)
        self.column = np.full(1 << BITS, -1, dtype=np.int32) if kept else None
        self.counts = np.zeros((len(known), len(kept)), dtype=np.float32)
        for i, (_, terms, n) in enumerate(kept):
            self.counts[np.searchsorted(known, terms), i] = n
        if kept:
            self.column[known] = np.arange(len(known))
        self.need = np.array([least * len(p.words) for p in self.passages], dtype=np.float32) - np.float32(1e-3)

    def candidates(self, terms: np.ndarray, half_of: np.ndarray, half_owner: np.ndarray):
        """Half windows, and passages of which the region around them, as in _verify, holds enough words."""
        if not self.passages:
            return
        column = self.column[terms]
        inside = np.flatnonzero(column >= 0)
        place, n = half_of[inside], len(half_owner)
        held = np.bincount(place, minlength=n)
        around = [(np.clip(np.arange(n) + k, 0, n - 1), k) for k in (-1, 0, 1, 2)]
        near = [(other, (half_owner[other] == half_owner) & (other == np.arange(n) + k)) for other, k in around]
        some = np.flatnonzero(sum(np.where(ok, held[other], 0) for other, ok in near) >= self.need.min())
        step = max(16, (1 << 21) // len(self.counts))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            present = np.zeros((len(part), len(self.counts)), dtype=np.float32)
            for other, ok in near:
                rows = np.flatnonzero(ok[part])
                halves = other[part[rows]]
                low, high = np.searchsorted(place, halves), np.searchsorted(place, halves, side="right")
                sizes = high - low
                flat = np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
                present[np.repeat(rows, sizes), column[inside[flat]]] = 1
            for w, p in np.argwhere(present @ self.counts >= self.need):
                yield part[w], self.passages[p]


class Search:
    """Finds benchmark passages in whole texts."""

    def __init__(self, bases: list[Basis], idf: np.ndarray, rare: np.ndarray, plain: float, cosine: float, least: float, sure: float):
        self.bases, self.square, self.tokens = bases, (idf**2).astype(np.float32), Tokens()
        self.cosine, self.least, self.sure = cosine, least, sure
        self.plain = [PlainWords(b.passages, rare, plain, least, self.tokens) for b in bases]

    def __call__(self, texts: list[str]) -> list[dict]:
        """For each text its items: {item: (share, cosine)}."""
        found: list[dict] = [{} for _ in texts]
        terms, owner, starts, ends, data = self.tokens(texts)
        if not len(terms):
            return found
        first = np.searchsorted(owner, np.arange(len(texts)))  # of each text, its first word
        place = np.arange(len(terms)) - first[owner]
        # Half windows: runs of HALF words that never cross texts.
        fresh = np.flatnonzero((place % HALF == 0))
        half_owner = owner[fresh]
        square = np.add.reduceat(self.square[terms], fresh)
        follows = np.append(half_owner[1:] == half_owner[:-1], False)
        half_of = np.cumsum(place % HALF == 0) - 1
        norm = np.sqrt(square + np.where(follows, np.append(square[1:], 0), 0)) + 1e-9
        for basis, plain in zip(self.bases, self.plain, strict=True):
            for w, p in plain.candidates(terms, half_of, half_owner):
                self._verify(found, p, 0.0, fresh[w], owner, starts, ends, data)
            row = basis.row[terms]
            inside = np.flatnonzero(row >= 0)
            if not len(inside) or not basis.latent.shape[1]:
                continue
            halves = half_of[inside]
            cut = np.flatnonzero(np.diff(halves, prepend=-1))
            held = halves[cut]
            # Folding needs a dense row only for half windows with a term of the block.
            vectors = np.zeros((len(held) + 1, basis.fold.shape[1]), dtype=np.float32)
            for at in range(0, len(cut), 4096):
                stop = min(at + 4096, len(cut))
                last = cut[stop] if stop < len(cut) else len(inside)
                vectors[at:stop] = np.add.reduceat(basis.fold[row[inside[cut[at] : last]]], cut[at:stop] - cut[at], axis=0)
            index = np.full(len(fresh) + 1, len(held))
            index[held] = np.arange(len(held))
            windows = np.unique(np.concatenate((held, held[(held > 0)] - 1)))
            windows = windows[follows[windows] | (index[windows] < len(held))]
            for at in range(0, len(windows), 4096):
                some = windows[at : at + 4096]
                folded = vectors[index[some]] + np.where(follows[some], 1, 0)[:, None].astype(np.float32) * vectors[index[np.where(follows[some], some + 1, some)]]
                bound = np.sqrt((folded**2).sum(axis=1)) / norm[some]
                some, folded = some[bound >= self.cosine], folded[bound >= self.cosine]
                if not len(some):
                    continue
                cosines = folded @ basis.latent.T / norm[some][:, None]
                for w, p in np.argwhere(cosines >= self.cosine):
                    self._verify(found, basis.passages[p], float(cosines[w, p]), fresh[some[w]], owner, starts, ends, data)
        return found

    def _verify(self, found, passage: Passage, cosine: float, at: int, owner, starts, ends, data) -> None:
        text = int(owner[at])
        if found[text].get(passage.item, (0.0,))[0] >= 1.0:
            return
        low, high = max(0, at - HALF), min(len(owner), at + 3 * HALF)
        words = [data[starts[k] : ends[k]] for k in range(low, high) if owner[k] == text]
        share = common_subsequence(passage.words, words) / len(passage.words)
        if share >= self.sure or share >= self.least and answered(passage.answer, words):
            found[text][passage.item] = max(found[text].get(passage.item, (0.0, 0.0)), (share, cosine))


def answered(answer: list[bytes], words: list[bytes]) -> bool:
    """Do the answer's words stand in the text together, in any order? An absent answer asks nothing."""
    if not answer:
        return True
    wanted, width = set(answer), 2 * len(answer)
    return any(wanted <= set(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def bases_of(benchmark: DataFrame, idf: np.ndarray, item: str = "item_id", text: str = "text") -> tuple[int, Iterator[list[Basis]]]:
    """Number of groups of latent bases, each for one reading of the corpus, and the groups, made one at a time."""

    def cut(batches):
        for batch in batches:
            made = [p for i, x in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True) for p in passages_of(i, x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.item for p in made], pa.int64()), pa.array([p.words for p in made], pa.list_(pa.binary())), pa.array([p.answer for p in made], pa.list_(pa.binary()))],
                names=["item", "words", "answer"],
            )

    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null").distinct()
    cuts = rows.mapInArrow(cut, "item long, words array<binary>, answer array<binary>")
    hashed = materialise(cuts.withColumn("at", F.xxhash64("item", "words")).dropDuplicates(["item", "at"]), "passages")
    n = hashed.count()
    blocks = max(1, -(-n // (BLOCK * 3 // 4)))
    dealt = hashed.withColumn("block", F.pmod(F.xxhash64("at", F.lit(1)), F.lit(blocks)).cast("int"))
    starts = range(0, blocks, BLOCKS) if n else range(0)
    return len(starts), ([latent_basis(dealt.where(F.col("block") == b), idf) for b in range(i, min(i + BLOCKS, blocks))] for i in starts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", cosine: float = COSINE, least: float = LEAST, sure: float = SURE, keep: bool = False) -> DataFrame:
    """`docs` with `leaks` array<struct<item_id, share, cosine>>, empty for clean documents.

    Null texts and texts of no words are clean. Items that are null or have under four words are
    not searched for; repeated items count once. Rows are never dropped; an empty table or an
    empty benchmark gives empty arrays. keep: the text stays in the result.
    """
    spark = docs.sparkSession
    frequency, n = document_frequencies(docs, text)
    idf = np.where(frequency > COMMON * n, 0.0, np.log((n + 1) / (frequency + 1.0)))
    # Common terms count for the length of a window by their own small weight.
    weight = np.log((n + 1) / (frequency + 1.0))
    uncommon = (frequency > 0) & (idf > 0)
    energy = float((frequency[uncommon] * idf[uncommon] ** 2).sum() / frequency[uncommon].sum()) if uncommon.any() else np.inf
    plain = (PLAIN * cosine) ** 2 * 2 * HALF * energy
    count, groups = bases_of(benchmark, idf)
    if not count:
        count, groups = 1, iter([[]])
    kind = "array<struct<item_id:bigint,share:double,cosine:double>>"
    out = docs
    for g, group in enumerate(groups):
        shared = spark.sparkContext.broadcast((group, weight, idf, plain))  # BLOCKS bases of BLOCK passages at most

        def start(shared=shared):
            search = Search(*shared.value, cosine, least, sure)

            def kernel(texts):
                rows = [[{"item_id": i, "share": s, "cosine": c} for i, (s, c) in sorted(x.items())] for x in search(texts)]
                return [rows]

            return kernel

        last = g == count - 1
        out = append_columns(out, text, [T.StructField("leaks" if g == 0 else "more", T._parse_datatype_string(kind))], start, drop=() if keep or not last else (text,), most=PIECE)
        if g:
            out = out.withColumn("leaks", F.concat("leaks", "more")).drop("more")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a benchmark passage, as they were."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return find_leaks(rows, benchmark, f"row.{text}", keep=True).where(F.size("leaks") == 0).select("row.*")
