"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their keys. Layout, little-endian but for keys:

    block*   entries: varint shared prefix, varint suffix length, varint value length, suffix, value
    index    for each block: varint key length, first key, u64 offset, u32 length, u32 crc32; then the last key
    bloom    u32 hash count, then the bits
    footer   FOOTER below, of a fixed size, at the very end

A key is a null marker, the identifier as a big-endian integer with its sign bit flipped, and a
number that tells repeated identifiers apart, so byte order is identifier order. A value is the
ids in the footer's width. A lookup reads footer, index and filter, leaves shards whose range or
Bloom filter excludes the key, searches the sparse index by bisection and reads one block. A scan
reads runs of blocks. So neither holds a whole file.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of

MAGIC = b"VSSTABL2"
#: index offset and length, bloom offset and length, documents, ids, bytes an id, crc32 of index and bloom, magic
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES, SHARD_BYTES, BITS_A_KEY, HASHES = 32 << 10, 32 << 20, 10, 7
#: Bytes of neighbouring blocks that a scan reads at a time.
READ_BYTES = 1 << 20
#: Runs that a worker's cache holds at most, in each of its two generations.
CACHE = 300_000
#: ASCII marks that may follow a word of letters and never belong to it.
MARKS = b",.!?;:|%&$*#()"
#: Normalisation and parting for which runs between ASCII white space can be encoded apart.
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: The byte-level scheme: printable bytes stand for themselves, the others for characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def encode_key(identifier: int | None, copy: int = 0) -> bytes:
    if identifier is None:
        return b"\0" + b"\0" * 8 + struct.pack(">I", copy)
    return b"\1" + struct.pack(">Q", (identifier + (1 << 63)) & ((1 << 64) - 1)) + struct.pack(">I", copy)


def decode_key(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _bloom_bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers of each hash, HASHES a row."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(size)


class Writer:
    """One shard, written block by block; only its index and key hashes stay in memory."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.block, self.last, self.index, self.hashes = bytearray(), b"", [], []
        self.documents = self.ids = 0
        self.first = b""

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if not self.block:
            self.index.append([key, self.at, 0, 0])
            self.last = b""
            self.first = self.first or key
        shared = len(os.path.commonprefix((key, self.last)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key[:9]))
        self.documents += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index[-1][2:] = len(self.block), zlib.crc32(self.block)
            self._put(bytes(self.block))
            self.block = bytearray()

    def finish(self) -> None:
        self.flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QII", at, n, crc) for k, at, n, crc in self.index) + self.last
        index_at = self.at
        self._put(index)
        size = max(64, len(self.hashes) * BITS_A_KEY)
        bits = np.zeros((size + 7) // 8 * 8, dtype=np.uint8)
        if self.hashes:
            bits[_bloom_bits(np.array(self.hashes, dtype=np.uint64), bits.size).ravel()] = 1
        bloom_at, bloom = self.at, struct.pack("<I", HASHES) + np.packbits(bits, bitorder="little").tobytes()
        self._put(bloom)
        self.stream.write(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.documents, self.ids, self.width, zlib.crc32(bloom, zlib.crc32(index)), MAGIC))


class Table:
    """A shard read in ranges, from a file that Arrow opened or from bytes: at first footer, index and filter alone."""

    def __init__(self, source):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        end = self.source.size()
        foot = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size)) if end >= FOOTER.size else (0,) * 8 + (b"",)
        index_at, index_size, _, bloom_size, self.documents, self.ids, self.width, crc, magic = foot
        tail = self._read(index_at, index_size + bloom_size) if magic == MAGIC else b""
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a whole shard")
        self.keys, self.blocks, at = [], [], 0
        self.bloom = tail[index_size + 4 :]
        size = len(encode_key(None))
        while at < index_size - size:
            n, at = _read_varint(tail, at)
            self.keys.append(tail[at : at + n])
            self.blocks.append(struct.unpack_from("<QII", tail, at + n))
            at += n + 16
        self.last = tail[at:index_size]

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _entries(self, first: int, stop: int):
        """Keys and values of neighbouring blocks, read at once."""
        start = self.blocks[first][0]
        data = memoryview(self._read(start, self.blocks[stop - 1][0] + self.blocks[stop - 1][1] - start))
        for place, size, crc in self.blocks[first:stop]:
            at, key = place - start, b""
            end = at + size
            if zlib.crc32(data[at:end]) != crc:
                raise ValueError("a broken block")
            while at < end:
                shared, at = _read_varint(data, at)
                n, at = _read_varint(data, at)
                length, at = _read_varint(data, at)
                key = key[:shared] + bytes(data[at : at + n])
                at += n
                yield key, data[at : at + length]
                at += length

    def scan(self):
        first = 0
        while first < len(self.blocks):
            stop, size = first + 1, self.blocks[first][1]
            while stop < len(self.blocks) and size + self.blocks[stop][1] <= READ_BYTES:
                size += self.blocks[stop][1]
                stop += 1
            yield from self._entries(first, stop)
            first = stop

    def may_hold(self, identifier: int | None) -> bool:
        wanted = encode_key(identifier)[:9]
        if not self.keys or not self.keys[0][:9] <= wanted <= self.last[:9]:
            return False
        bits = _bloom_bits(np.array([xxhash.xxh64_intdigest(wanted)], dtype=np.uint64), len(self.bloom) * 8)[0]
        return all(self.bloom[b // 8] >> b % 8 & 1 for b in bits.tolist())

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier."""
        if not self.may_hold(identifier):
            return []
        wanted, found = encode_key(identifier)[:9], []
        block = max(0, bisect.bisect_left(self.keys, wanted) - 1)
        while block < len(self.keys) and self.keys[block][:9] <= wanted:
            found += [self.unpack(value) for key, value in self._entries(block, block + 1) if key[:9] == wanted]
            block += 1
        return found

    def unpack(self, value) -> np.ndarray:
        return np.frombuffer(value, dtype="<u2" if self.width == 2 else "<u4").astype("<u4")


class Runs(dict):
    """Ids of runs of characters, made when first asked for; the last CACHE before the present ones are kept too."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if (made := self.old.get(run)) is None:
            made = self.make(run)
        self[run] = made
        return made


class WordCache:
    """Encodes texts by the runs between ASCII white space, each run once.

    Where the definition isn't known to part texts there (APART), whole texts go to the library.
    """

    def __init__(self, definition: str, width: int, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.code = "H" if width == 2 else "I"
        self.end = self._pack([end_id])
        self.model = self.tokenizer.model
        stated = json.loads(definition)
        self.apart = all(stated.get(k) == v for k, v in APART.items()) and stated["model"]["type"] == "BPE" and not stated["model"].get("dropout") and not stated.get("truncation")
        self.runs = Runs(self._run)
        self.tails: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [self._pack(x.ids) + self.end for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        found = self.runs.__getitem__
        return [b"".join(map(found, x.encode().split())) + self.end for x in texts]

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _run(self, run: bytes) -> bytes:
        """Ids of a run. A word of letters and the marks behind it are pieces of their own, so each
        is looked up alone; in such a word nothing is left to normalise, and it goes to the model."""
        lower = run.lower()
        word = lower.rstrip(MARKS)
        text = word.decode()
        if not (text.isalpha() and (text.isascii() or text == text.lower() and unicodedata.is_normalized("NFC", text))):
            return self._whole(run)
        if word != run:
            made = self.runs[word]
            if len(word) == len(lower):
                return made
            marks = lower[len(word) :]
            if (tail := self.tails.get(marks)) is None:
                tail = self._whole(marks)
                if len(self.tails) < 10_000:
                    self.tails[marks] = tail
            return made + tail
        spelt = text if text.isascii() else word.decode("latin-1").translate(BYTE_LEVEL)
        return self._pack([t.id for t in self.model.tokenize(spelt)])

    def _whole(self, run: bytes) -> bytes:
        return self._pack(self.tokenizer.encode(run.decode(), add_special_tokens=False).ids)


def write_shards(df: DataFrame, tokenizer_path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenize every text and write shards under `folder`, a URI that all executors reach.

    Returns a row a shard: path, first_key binary, documents, ids. Rows are dealt by ranges of
    (key, text hash) and sorted, so that shards are disjoint key ranges and a repeated key spreads.
    Null texts count as empty and hold the end id alone; null keys come first; repeated rows stay.
    An empty table writes no shard. A task that runs again replaces its files by equal ones.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(definition).get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
    shared = df.sparkSession.sparkContext.broadcast(definition)  # one vocabulary, a few MB
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        words, part, made = WordCache(shared.value, width, end_id), TaskContext.get().partitionId(), 0
        writer = stream = temporary = None
        last, copy = object(), 0

        def close():
            nonlocal writer, made
            writer.finish()
            stream.close()
            path = f"{root}/shard-{part:07d}-{made:05d}.sst"
            store.move(temporary, path)
            row = {"path": path.rsplit("/", 1)[-1], "first_key": writer.first, "documents": writer.documents, "ids": writer.ids}
            writer, made = None, made + 1
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for piece in slices(batch, "text"):
                keys = piece.column(0).to_pylist()
                for k, value in zip(keys, words.encode(texts_of(piece, "text")), strict=True):
                    copy = copy + 1 if k == last else 0
                    last = k
                    if writer is None:
                        temporary = f"{root}/.part-{uuid.uuid4().hex}"
                        stream = store.open_output_stream(temporary)
                        writer = Writer(stream, width)
                    writer.add(encode_key(k, copy), value)
                    if writer.at >= shard_bytes:
                        yield close()
        if writer is not None:
            yield close()

    return rows.mapInArrow(run, "path string, first_key binary, documents long, ids long")


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name and bytes of every shard under `folder`; no content is read."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)  # a table without rows wrote none
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("bytes"))


def _opened(folder: str):
    """A function from the name of a shard to its table, for use in a task."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    return lambda name: Table(store.open_input_file(f"{root}/{name}"))


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """path, first_key, documents and ids of every shard, from its footer and index; an empty folder gives no rows."""

    def run(batches):
        table_of = _opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                table = table_of(path)
                yield pa.RecordBatch.from_pylist([{"path": path, "first_key": table.keys[0], "documents": table.documents, "ids": table.ids}])

    return shard_files(spark, folder).select("path").mapInArrow(run, "path string, first_key binary, documents long, ids long")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards: path, first_key, place, doc_id, before (ids of the same shard before it), ids.

    An empty folder gives no rows.
    """

    def run(batches):
        table_of = _opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                table = table_of(path)
                rows, place, before, held = [], 0, 0, 0
                for key, value in table.scan():
                    ids = table.unpack(value)
                    rows.append((path, table.keys[0], place, decode_key(key), before, ids.tobytes()))
                    place, before, held = place + 1, before + len(ids), held + ids.nbytes
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return shard_files(spark, folder).select("path").mapInArrow(run, _READ)


_READ = "path string, first_key binary, place long, doc_id long, before long, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["path", "first_key", "place", "doc_id", "before", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def lookup(spark: SparkSession, folder: str, identifiers: list[int]) -> DataFrame:
    """doc_id and ids of the documents of a few identifiers, by range, filter and bisection in each shard.

    Unknown identifiers and an empty folder give no rows.
    """

    def run(batches):
        table_of = _opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                table = table_of(path)
                found = [(i, x.tobytes()) for i in identifiers for x in table.get(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "ids"])

    return shard_files(spark, folder).select("path").mapInArrow(run, "doc_id long, ids binary")


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards.

    The running sum over shards is over their footers, a row for some 32 MB of ids.
    """
    rank = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest_of(spark, folder).select("path", F.coalesce(F.sum("ids").over(rank), F.lit(0)).alias("shard_start"))
    docs = read_shards(spark, folder).select("path", "doc_id", "before", F.length("ids").alias("bytes"), F.crc32("ids").alias("ids_crc32"))
    return docs.join(starts, "path").select(
        "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), (F.col("bytes") / 4).cast(T.LongType()).alias("n_tokens"), "ids_crc32"
    )
