"""Subword lattice likelihood of documents.

A given piece vocabulary spans a lattice over each word: every way to spell the word in pieces is
a path, and the forward recursion, in log space, sums the probabilities of all paths. The pieces'
scores start from the order of the vocabulary and are fitted to the corpus's words by expectation
maximisation over the same lattices. A word seen in training has two more arcs from the start of
its lattice to its end: its discounted frequency in the group and in all groups. What the discounts
leave is the weight of the arcs into the pieces, so the forward sum over all paths is the word's
probability; it stays in logs. A document's probability is the product over its words and an end,
marginal over the groups (languages) of the training documents.

Counts are of the whole corpus. A document meets the frequent words' scores, a table of fixed
size, where it is read; its rarer words go through a join on the word.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, texts_of

#: Frequent words whose scores are broadcast; groups of the mixture; words and bytes of text counted before a flush.
FREQUENT, GROUPS, FLUSH, FLUSH_BYTES = 1 << 16, 8, 400_000, 64 << 20
#: Discount of counts where the counts of counts give none, weight of a vocabulary's own order in piece scores, log of a fallback byte.
DISCOUNT, PRIOR, BYTE = 0.6, 1.0, float(np.log(1e-4 / 256))
LN10 = math.log(10.0)
#: Longest word that goes through the vectorised lattice, "no path".
VECTOR, NONE = 48, -1e30
START = "▁"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of rows of character codes, and the powers of the base."""
    n, width = codes.shape
    prefix = np.zeros((n, width + 1), dtype=np.uint64)
    for i in range(width):
        prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(width, _BASE))))
    return prefix, powers


def _codes(words: list[str]) -> np.ndarray:
    return np.array([[ord(c) for c in w] for w in words], dtype=np.uint32)


class Pieces:
    """A piece vocabulary in hash tables: substring hash to piece number."""

    def __init__(self, pieces: list[str]):
        self.pieces = [p for p in dict.fromkeys(pieces) if p]
        self.longest = max(map(len, self.pieces), default=1)
        self.first = np.array([p.startswith(START) for p in self.pieces], dtype=bool)
        self.number = {p: i for i, p in enumerate(self.pieces)}
        keys = np.zeros(len(self.pieces), dtype=np.uint64)
        for size in {len(p) for p in self.pieces}:
            own = [i for i, p in enumerate(self.pieces) if len(p) == size]
            keys[own] = _hashes(_codes([self.pieces[i] for i in own]))[0][:, -1]
        # Levels of direct tables: what collides in one goes to the next, and its place is marked.
        self.levels, left, bits = [], np.arange(len(keys)), 20
        while len(left):
            place = (keys[left] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)
            _, one = np.unique(place, return_index=True)
            table, ids, more = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32), np.zeros(1 << bits, dtype=bool)
            table[place[one]], ids[place[one]] = keys[left[one]], left[one]
            more[np.delete(place, one)] = True
            self.levels.append((bits, table, ids, more))
            left, bits = np.delete(left, one), max(10, bits - 4)

    def find(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        """Piece numbers of substring hashes, -1 for none."""
        if level == len(self.levels):
            return np.full(keys.shape, -1, dtype=np.int32)
        bits, table, ids, more = self.levels[level]
        place = keys * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)
        out = np.where(table[place] == keys, ids[place], np.int32(-1))
        again = (out < 0) & more[place]
        if again.any():
            out[again] = self.find(keys[again], level + 1)
        return out


@dataclass
class Scores:
    """A group's log probabilities: of pieces (first in a word, or following and going on), and of stopping."""

    piece: np.ndarray
    stop: float

    @staticmethod
    def of(expected: np.ndarray, first: np.ndarray, words: float) -> Scores:
        """From expected counts; the vocabulary's order gives each piece a small prior count."""
        counts = expected + PRIOR / (np.arange(len(expected)) + 10.0)
        total = max(counts.sum(), 1e-9)
        stop = min(0.9, max(0.05, words / total))
        logs = np.log(counts)
        logs[first] -= np.log(counts[first].sum() or 1.0)
        logs[~first] += np.log1p(-stop) - np.log(counts[~first].sum() or 1.0)
        return Scores(logs, float(np.log(stop)))


class Lattice:
    """Forward (and backward) recursions over the spellings of words."""

    def __init__(self, pieces: Pieces, scores: list[Scores]):
        self.pieces, self.scores = pieces, scores

    def _arcs(self, words: list[str]):
        """For words of one length: the piece of each length at each place, and what a single character's bytes cost."""
        text = _codes([START + w for w in words])
        prefix, powers = _hashes(text)
        width = text.shape[1]
        size = 1 + (text > 0x7F).astype(np.int64) + (text > 0x7FF) + (text > 0xFFFF)
        found = {l: self.pieces.find(prefix[:, l:] - prefix[:, :-l] * powers[l]) for l in range(1, min(self.pieces.longest, width) + 1)}
        return width, {l: ids for l, ids in found.items() if l == 1 or (ids >= 0).any()}, BYTE * size

    @staticmethod
    def _logs(ids, fallback, scores: Scores):
        logs = {l: np.where(found >= 0, scores.piece[found], NONE) for l, found in ids.items()}
        logs[1] = np.logaddexp(logs[1], fallback)  # every single character can fall back to its bytes
        return logs

    @staticmethod
    def forward(width: int, logs) -> np.ndarray:
        alpha = np.full((len(logs[1]), width + 1), NONE)
        alpha[:, 0] = 0.0
        for i in range(1, width + 1):
            paths = np.stack([alpha[:, i - l] + logs[l][:, i - l] for l in logs if l <= i])
            top = paths.max(axis=0)
            alpha[:, i] = top + np.log(np.exp(paths - top).sum(axis=0))
        return alpha

    def long(self, word: str, scores: Scores, back: bool = False) -> list[float]:
        """The same recursion for one long word, place by place: sums over the paths to each place, or from it on."""
        text, number, score = START + word, self.pieces.number, scores.piece
        end, ways = len(text), [0.0] * (len(text) + 1)
        for i in range(end - 1, -1, -1) if back else range(1, end + 1):
            paths = [ways[i + 1] + BYTE * len(text[i].encode())] if back else [ways[i - 1] + BYTE * len(text[i - 1].encode())]
            for l in range(1, min(end - i if back else i, self.pieces.longest) + 1):
                k = number.get(text[i : i + l] if back else text[i - l : i])
                if k is not None:
                    paths.append(ways[i + l if back else i - l] + score[k])
            top = max(paths)
            ways[i] = top + math.log(sum(math.exp(p - top) for p in paths))
        return ways

    def long_expected(self, word: str, scores: Scores, total: np.ndarray) -> None:
        """Add the expected uses of each piece over the spellings of one long word."""
        text, number, score = START + word, self.pieces.number, scores.piece
        alpha, beta = self.long(word, scores), self.long(word, scores, back=True)
        for i in range(len(text)):
            for l in range(1, min(len(text) - i, self.pieces.longest) + 1):
                k = number.get(text[i : i + l])
                if k is not None:
                    total[k] += math.exp(alpha[i] + score[k] + beta[i + l] - alpha[-1])

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Natural-log probability of each word under each group, over all its spellings."""
        out = np.zeros((len(self.scores), len(words)))
        for rows in _by_length(words):
            some = [words[i] for i in rows]
            if len(some[0]) > VECTOR:
                for g, scores in enumerate(self.scores):
                    out[g, rows] = [self.long(w, scores)[-1] + scores.stop for w in some]
            else:
                width, ids, fallback = self._arcs(some)
                for g, scores in enumerate(self.scores):
                    out[g, rows] = self.forward(width, self._logs(ids, fallback, scores))[:, -1] + scores.stop
        return out

    def expected(self, words: list[str], group: int) -> np.ndarray:
        """Expected uses of each piece over the words' spellings."""
        scores = self.scores[group]
        total = np.zeros(len(self.pieces.pieces))
        for rows in _by_length(words):
            if len(words[rows[0]]) > VECTOR:
                for i in rows:
                    self.long_expected(words[i], scores, total)
                continue
            width, ids, fallback = self._arcs([words[i] for i in rows])
            logs = self._logs(ids, fallback, scores)
            alpha = self.forward(width, logs)
            beta = np.full((len(rows), width + 1), NONE)
            beta[:, width] = 0.0
            for i in range(width - 1, -1, -1):
                paths = np.stack([logs[l][:, i] + beta[:, i + l] for l in logs if l <= width - i])
                top = paths.max(axis=0)
                beta[:, i] = top + np.log(np.exp(paths - top).sum(axis=0))
            for l, found in ids.items():
                hit = found >= 0
                share = scores.piece[found] + alpha[:, : width + 1 - l] + beta[:, l:] - alpha[:, -1:]
                total += np.bincount(found[hit], np.exp(share[hit]), minlength=len(total))
        return total


def _by_length(words: list[str], most: int = 4096):
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), most):
            yield rows[at : at + most]


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def count_words(docs: DataFrame, groups: list[str | None]) -> DataFrame:
    """word binary and c0.. long, its count in the training documents of each group.

    docs: text, train boolean, group string. Words of other documents come with counts of 0.
    """
    place = {g: i for i, g in enumerate(groups)}
    width = len(groups)
    schema = "word binary, " + ", ".join(f"c{i} long" for i in range(width))

    def run(batches):
        found: list[Counter] = [Counter() for _ in range(width + 1)]

        def flush():
            words = list(dict.fromkeys(w for c in found for w in c))
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())] + [pa.array([c.get(w, 0) for w in some], pa.int64()) for c in found[:width]], names=["word"] + [f"c{i}" for i in range(width)])
            for c in found:
                c.clear()

        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                held += part.column(0).nbytes
                for text, train, group in zip(texts_of(part, "text"), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found[place.get(group, width - 1) if train else width].update(words_of(text))
                if sum(map(len, found)) > FLUSH or held > FLUSH_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select("text", "train", "group").mapInArrow(run, schema)
    return rows.groupBy("word").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)])


def _strings(batch: pa.RecordBatch) -> list[str]:
    return [w.decode(errors="replace") for w in batch.column(batch.schema.get_field_index("word")).to_pylist()]


def fit_pieces(counts: DataFrame, pieces: Pieces, width: int, rounds: int = 2) -> list[Scores]:
    """Each group's piece scores, by expectation maximisation over its distinct training words."""
    spark, size = counts.sparkSession, len(pieces.pieces)
    scores = [Scores.of(np.zeros(size), pieces.first, 0.3 * PRIOR) for _ in range(width)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, scores))  # GROUPS scores a piece at most

        def run(batches, shared=shared):
            lattice = Lattice(*shared.value)
            total, words = np.zeros((width, size)), np.zeros(width)
            for batch in batches:
                some = _strings(batch)
                for g in range(width):
                    own = [w for w, c in zip(some, batch.column(1 + g).to_pylist(), strict=True) if c]
                    total[g] += lattice.expected(own, g)
                    words[g] += len(own)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1 - np.arange(width))), pa.array(np.append(total.ravel()[used], words))], names=["place", "n"])

        rows = counts.mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
        place, n = rows["place"].to_numpy(), rows["n"].to_numpy()
        expected, words = np.zeros(width * size), np.zeros(width)
        expected[place[place >= 0]] = n[place >= 0]
        words[-1 - place[place < 0]] = n[place < 0]
        scores = [Scores.of(x, pieces.first, float(w) or 0.3 * PRIOR) for x, w in zip(expected.reshape(width, size), words, strict=True)]
    return scores


@dataclass
class Totals:
    """Of each group and of all: tokens, distinct tokens, documents; ends are tokens."""

    tokens: list[int]
    kinds: list[int]
    documents: list[int]
    all_kinds: int
    discount: float = DISCOUNT

    @property
    def n(self) -> int:
        return sum(self.tokens)


def word_scores(counts: DataFrame, pieces: Pieces, scores: list[Scores], totals: Totals) -> DataFrame:
    """word, n (its training count), base and s0.., log10 probabilities of the base and of each group."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast((pieces, scores))
    width = len(totals.tokens)

    def run(batches):
        lattice = Lattice(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                spelt = lattice.likelihoods(_strings(part))
                c = np.stack([part.column(1 + i).to_numpy(zero_copy_only=False) for i in range(width)]).astype(float)
                logs = group_scores(c, spelt, totals)
                n = c.sum(axis=0)
                base = np.log10((n + 0.5) / (totals.n + 0.5 * (totals.all_kinds + 1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(base), *map(pa.array, logs)], names=["word", "n", "base"] + [f"s{i}" for i in range(width)])

    schema = "word binary, n long, base double, " + ", ".join(f"s{i} double" for i in range(width))
    return counts.mapInArrow(run, schema)


def group_scores(c: np.ndarray, spelt: np.ndarray, totals: Totals) -> np.ndarray:
    """log10 probability of words under each group: the forward sum over the arc of the group, that of all, and the pieces.

    c: counts, a row a group; spelt: natural logs of the spellings' probabilities. Stays in logs,
    so words of any length keep their probability.
    """
    n, cut = totals.n, totals.discount
    log = lambda x: np.log(np.maximum(x, 0.0))
    out = []
    with np.errstate(divide="ignore"):
        common = log((c.sum(axis=0) - cut) / n) if n else np.full(c.shape[1], -np.inf)
        left = log(cut * totals.all_kinds / n) if n else 0.0
        for row, tokens, own, spelling in zip(c, totals.tokens, totals.kinds, spelt, strict=True):
            p = np.logaddexp(common, left + spelling)
            if tokens:
                p = np.logaddexp(log((row - cut) / tokens), log(cut * own / tokens) + p)
            out.append(p / LN10)
    return np.array(out)


def frequent_words(words: DataFrame, most: int | None = None) -> DataFrame:
    """The words above the least count that at most `most` words reach, counts being told apart by eighths of octaves.

    Only the histogram of counts, a few hundred rows, is gathered to find that count.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    seen = words.where("n > 0")
    sizes = seen.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("level")).collect()
    total, least = 0, 1 << 30
    for r in sizes:
        total += r["size"]
        if total > (most or FREQUENT):
            break
        least = r["level"]
    return seen.where(level >= least)


def score_documents(docs: DataFrame, pieces_of: list[str], train: Column, key: str = "doc_id", text: str = "text", group: str = "lang") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    train says which rows to learn from (null: not). Null texts count as empty and still have an
    end; repeated rows stay, each with its score. group names a column whose GROUPS - 1 most
    frequent values, and one for the rest and nulls, are the groups of the mixture. Without
    training rows words have their spelling's score under the vocabulary's own order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.col(group).cast("string").alias("group"))
    sizes = rows.where("train and group is not null").groupBy("group").count().orderBy(F.desc("count"), "group").limit(GROUPS - 1).collect()
    groups: list[str | None] = [r["group"] for r in sizes] + [None]
    width = len(groups)
    counts = materialise(count_words(rows, groups), "words")
    named = F.when(F.col("group").isin([g for g in groups if g is not None]), F.col("group"))
    ends = {r["g"]: r["n"] for r in rows.where("train").groupBy(named.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    documents = [ends.get(g, 0) for g in groups]
    seen = " + ".join(f"c{i}" for i in range(width))
    sums = counts.agg(*[F.sum(f"c{i}") for i in range(width)], *[F.count(F.when(F.col(f"c{i}") > 0, 1)) for i in range(width)], *[F.count(F.when(F.expr(seen) == k, 1)) for k in (1, 2)], F.count(F.when(F.expr(seen) > 0, 1))).first()
    once, twice = sums[2 * width], sums[2 * width + 1]
    totals = Totals(
        [(sums[i] or 0) + documents[i] for i in range(width)],
        [sums[width + i] + (documents[i] > 0) for i in range(width)],
        documents,
        sums[2 * width + 2] + (sum(documents) > 0),
        min(0.95, max(0.4, once / (once + 2 * twice))) if once else DISCOUNT,
    )
    pieces = Pieces(pieces_of)
    scores = fit_pieces(counts.where(F.expr(seen) > 0), pieces, width)
    words = materialise(word_scores(counts, pieces, scores, totals), "word_scores")
    names = ["base", *[f"s{i}" for i in range(width)]]
    top = frequent_words(words).toPandas()  # FREQUENT rows at most
    frequent = spark.sparkContext.broadcast((top["word"].tolist(), top[names].to_numpy()))
    n_end = np.array([[float(d)] for d in documents])
    end_logs = group_scores(n_end, np.full((width, 1), math.log(1e-12)), totals)[:, 0].tolist()
    end_base = float(np.log10((sum(documents) + 0.5) / (totals.n + 0.5 * (totals.all_kinds + 1))))
    end_known = int(sum(documents) > 0)

    def look(batches):
        listed, table = frequent.value
        place = {bytes(w): i for i, w in enumerate(listed)}
        table = np.vstack([table, np.zeros((1, table.shape[1]))])
        missing, number = len(listed), 0
        for batch in batches:
            for part in slices(batch, "text"):
                word, times, owner, plain = [], [], [], []
                for i, x in enumerate(texts_of(part, "text")):
                    own = words_of(x)
                    at = np.array([place.get(w, missing) for w in own], dtype=np.int64)
                    rest = Counter(own[k] for k in np.flatnonzero(at == missing))
                    sums = table[at].sum(axis=0)
                    plain.append([1.0, len(own) + 1.0, float((at < missing).sum()) + end_known, *(sums + [end_base, *end_logs]).tolist()])
                    # A text's own row has a word that no text has, another for each row, so that these rows spread in the join.
                    word.append(b" %d" % number)
                    number += 1
                    word += rest.keys()
                    times += [1, *rest.values()]
                    owner += [i] * (len(rest) + 1)
                rows = [None] * len(owner)
                for k, w in enumerate(np.searchsorted(np.array(owner), np.arange(len(plain))).tolist()):
                    rows[w] = plain[k]
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(word, pa.binary()), pa.array(times, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["key", "tie", "word", "times", "plain"])

    kind = docs.schema[key].dataType.simpleString()
    parts = rows.select("key", F.xxhash64("text").alias("tie"), "text").mapInArrow(look, f"key {kind}, tie long, word binary, times long, plain array<double>")
    scored = words.select("word", F.col("n").alias("seen"), F.array(*names).alias("logs"))
    # A text's own row brings its sums, a rarer word's row its share of them.
    met = parts.join(scored, "word", "left")
    own = F.col("plain").isNotNull()
    named = ["copies", "n_tokens", "n_known", *names]
    values = {"copies": F.lit(0.0), "n_tokens": F.lit(0.0), "n_known": F.when(F.col("seen") > 0, F.col("times")).otherwise(0).cast("double")} | {c: F.col("times") * F.col("logs")[i] for i, c in enumerate(names)}
    summed = met.groupBy("key", "tie").agg(*[F.sum(F.when(own, F.col("plain")[i]).otherwise(values[c])).alias(c) for i, c in enumerate(named)])
    # Rows that agree in key and text were added up; each gets its share back.
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    shares = [d / max(1, sum(documents)) for d in documents] if sum(documents) else [1.0 / width] * width
    logs = [F.col(f"s{i}") / F.col("copies") + F.lit(float(np.log10(p))) for i, p in enumerate(shares) if p > 0]
    peak = F.greatest(*logs) if len(logs) > 1 else logs[0]
    mixed = peak + F.log10(sum((F.pow(F.lit(10.0), x - peak) for x in logs), F.lit(0.0)))
    return each.select(
        F.col("key").alias(key),
        (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        mixed.alias("score"),
    )


def vocabulary(model_file: str) -> list[str]:
    """Pieces of a sentencepiece model in the order of its scores; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in sorted(plain, key=lambda i: -model.get_score(i))]
