"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is a product of its characters, and an encoding of it an element of a monoid: `Span.join`
takes the encodings of two neighbouring texts to that of their concatenation. Encoding halves a
text down to leaves and joins upwards; decoding concatenates up the same tree.

Two seams have to heal in a join.

*Pieces.* The pattern cuts a text from left to right; where a match starts settles everything to
its right, and a match never reads more than two characters beyond its own end. So left of the
seam every piece that ends two or more characters before it stands. The rest is matched again
over a window that grows to the right until a cut, two characters inside the window, falls on a
cut of the right span; from there both cuts agree for good.

*Merges inside a piece.* A row of tokens is the encoding of its bytes exactly if each two
neighbours are the encoding of their own concatenation. In joining two encoded byte strings a
window of tokens around the seam is encoded again; it grows until the pairs at both its rims
pass that test, after which no token outside can change.
"""

from __future__ import annotations

import base64
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

#: Characters of a leaf of the text tree; bytes of a leaf inside a piece, of a remembered part and
#: of a remembered piece; entries that each of the three caches of a worker holds at most.
LEAF_CHARS, LEAF_BYTES, KEPT_BYTES, KEPT_PIECE, CACHE = 1 << 14, 20, 8, 64, 200_000
NEVER = 1 << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Ranks and pattern, with joins of neighbouring encodings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.scan = regex.compile(pattern).finditer
        self.units = [ranks[bytes([i])] for i in range(256)]
        #: The rank that two neighbouring tokens merge into, for all ways to cut a token in two.
        self.pair_rank = {
            ranks[token[:i]] << 20 | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # Inside a piece.
    def merge(self, data: bytes) -> list[int]:
        """Encode a short byte string by merging the neighbours of the lowest rank."""
        get, units = self.pair_rank.get, self.units
        ids = [units[x] for x in data]
        scores = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while scores:
            best = min(scores)
            if best == NEVER:
                break
            i = scores.index(best)
            ids[i] = best
            del ids[i + 1], scores[i]
            if i:
                scores[i - 1] = get(ids[i - 1] << 20 | best, NEVER)
            if i < len(scores):
                scores[i] = get(best << 20 | ids[i + 1], NEVER)
        return ids

    def stable(self, a: int, b: int) -> bool:
        """Do two neighbouring tokens stay as they are?"""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenated bytes of two encodings of one piece."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = b"".join(self.tokens[x] for x in left[i:] + right[:j])
            middle = self.merge(window)
            if (i == 0 or self.stable(left[i - 1], middle[0])) and (j == len(right) or self.stable(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            size *= 2

    def halve(self, data: bytes) -> list[int]:
        """Encode halves of a byte string and join them; short strings are remembered."""
        if (known := self.parts.get(data)) is not None:
            return known
        if len(data) <= LEAF_BYTES:
            made = self.merge(data)
        else:
            middle = (len(data) + 1) // 2
            made = self.join(self.halve(data[:middle]), self.halve(data[middle:]))
        if len(data) <= KEPT_BYTES:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[data] = made
        return made

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern as little-endian unsigned 32-bit integers, cached."""
        data = text.encode()
        if (made := self.older.get(text)) is None:
            whole = self.ranks.get(data)
            made = array("I", [whole] if whole is not None else self.halve(data)).tobytes()
        if len(data) <= KEPT_PIECE:
            if len(self.cache) >= CACHE:  # two generations: what is in use comes back from the older one
                self.older, self.cache = self.cache, {}
            self.cache[text] = made
        return made

    # Over the text.
    def pieces(self, text: str) -> list[str]:
        """Matches of the pattern, by halves of the text joined at their seams."""
        if len(text) <= LEAF_CHARS:
            return self.cut(text)
        middle = len(text) // 2
        left, right = self.pieces(text[:middle]), self.pieces(text[middle:])
        return self.seam(left, right)

    def seam(self, left: list[str], right: list[str]) -> list[str]:
        """Join the pieces of two neighbouring texts."""
        tail, back = len(left), 0
        while tail and back < 2:
            tail -= 1
            back += len(left[tail])
        head = "".join(left[tail:])
        size = 4
        while True:
            window = head + "".join(right[:size])
            whole = size >= len(right)
            ends, at = {}, len(head)
            for k, x in enumerate(right[:size]):
                at += len(x)
                ends[at] = k + 1
            made = []
            for match in self.scan(window):
                end = match.end()
                if not whole and end > len(window) - 2:
                    break
                made.append(match[0])
                if end in ends:
                    return left[:tail] + made + right[ends[end] :]
            if whole:
                return left[:tail] + made
            size *= 2

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([self.cache.get(x) or self.piece(x) for x in self.pieces(text)])

    def decode(self, ids: list[int]) -> bytes:
        return decoded(self.tokens, ids)


def decoded(tokens: dict[int, bytes], ids: list[int]) -> bytes:
    """Bytes of a row of ids, concatenated up the tree of its halves."""
    if len(ids) <= 4096:
        return b"".join(map(tokens.__getitem__, ids))
    middle = len(ids) // 2
    return decoded(tokens, ids[:middle]) + decoded(tokens, ids[middle:])


_LAST: dict[tuple[int, str], Codec] = {}


def codec_of(data: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary file; a worker keeps the last one from task to task, with its bounded caches."""
    key = (hash(data), pattern)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Codec(read_ranks(data), pattern)
    return _LAST[key]


def _vocabulary(spark: SparkSession, path: str):
    """The file's bytes, broadcast: a vocabulary is a few MB whatever the corpus."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add `n_tokens` long and `ids` binary (little-endian unsigned 32-bit integers) to every row.

    Null texts count as empty and give no ids; rows are never dropped or merged, so repeated rows
    come out repeated; an empty table gives an empty one. Columns of the same names are replaced.
    The pattern must match every character, as the tokenizers' patterns do.
    """
    data = _vocabulary(df.sparkSession, ranks_path)

    def start():
        codec = codec_of(data.value, pattern)

        def kernel(texts):
            ids = [codec.encode(x) for x in texts]
            return [[len(x) // 4 for x in ids], ids]

        return kernel

    return append_columns(df, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], start, drop)


def decode_documents(df: DataFrame, ranks_path: str, ids: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add `decoded` binary, the bytes that the ids of each row stand for; null ids give empty bytes."""
    data = _vocabulary(df.sparkSession, ranks_path)

    def start():
        tokens = {rank: token for token, rank in read_ranks(data.value).items()}

        def kernel(rows):
            return [[decoded(tokens, array("I", x or b"").tolist()) for x in rows]]

        return kernel

    return append_columns(df, ids, [T.StructField("decoded", T.BinaryType())], start, drop)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add `n_tokens`, `ids` and `decoded`, the bytes that the ids stand for, with one codec for both ways.

    Nulls, empty texts, repeated rows and clashing columns are treated as by encode_documents.
    """
    data = _vocabulary(df.sparkSession, ranks_path)

    def start():
        codec = codec_of(data.value, pattern)

        def kernel(texts):
            ids = [codec.encode(x) for x in texts]
            return [[len(x) // 4 for x in ids], ids, [codec.decode(array("I", x).tolist()) for x in ids]]

        return kernel

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return append_columns(df, text, fields, start, drop)


def digests(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; null texts count as empty, an empty table gives an empty one."""
    made = round_trip(docs.select("doc_id", "text"), ranks_path, pattern, drop=("text",))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
