import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from vitalspark.llm import byte_bpe, sstable
from vitalspark.llm.common import materialise, shared_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdehinorst '  \n\t'rlvesdm123éßABÉ漢字€🙂.,!?-  \x1c\x85<|>"


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        return byte_bpe.Codec(byte_bpe.read_ranks(file.read()), public_tokenizers.PATTERN)


def noise(n, seed, size=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(size))) for _ in range(n)]


def test_tree_encoding_equals_the_library(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", 3)
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", 2)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(4)
    runs = ["".join(rnd.choice("theonrasdin") for _ in range(rnd.randrange(400))) for _ in range(40)]
    for text in noise(1500, 1) + runs + ["", " ", "'r", "x're", "   a", "a   "]:
        codec.cache.clear()
        codec.older.clear()
        ids = codec.encode(text)
        assert list(array("I", ids)) == library.encode_ordinary(text), text
        assert codec.decode(list(array("I", ids))) == text.encode()


def test_join_is_associative(codec):
    rnd = random.Random(8)
    for _ in range(200):
        a, b, c = ("".join(rnd.choice("theonrasdin") for _ in range(rnd.randrange(1, 20))).encode() for _ in range(3))
        x, y, z = map(codec.halve, (a, b, c))
        assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z)) == codec.merge(a + b + c)


def test_documents_round_trip(spark, awkward, nothing):
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(awkward, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == awkward.count()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)
    assert {r["n_tokens"] for r in rows if not r["text"]} == {0}
    clash = awkward.withColumnRenamed("source", "ids").withColumnRenamed("n_chars", "n_tokens")
    assert byte_bpe.encode_documents(clash, RANKS, public_tokenizers.PATTERN).columns == ["doc_id", "text", "lang", "n_tokens", "ids"]
    assert byte_bpe.digests(spark, nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_cache_equals_the_library():
    with open(WORDS, encoding="utf-8") as file:
        cache = sstable.WordCache(file.read(), 2, 2)
    texts = noise(3000, 6) + ["don't, we'Re. 's", "ΑΣ. ΑΣ", "x <|endoftext|> y.", "éa"]
    library = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    for text, made, want in zip(texts, cache.encode(texts), library):
        assert list(array("H", made)) == want.ids + [2], text


def test_shards(spark, awkward, nothing):
    folder = shared_path(spark, "shards")
    manifest = materialise(sstable.write_shards(awkward, WORDS, folder, shard_bytes=1 << 12), "manifest")
    assert manifest.agg({"documents": "sum"}).first()[0] == awkward.count()
    rows = sstable.positions(spark, folder).orderBy("start").collect()
    library = Tokenizer.from_file(WORDS)
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect() if r["doc_id"] is not None}
    for identifier in (1, 3, 6, 8):
        found = sstable.lookup(spark, folder, [identifier]).collect()
        assert [list(array("I", bytes(f["ids"]))) for f in found] == [library.encode(texts[identifier], add_special_tokens=False).ids + [2]]
    assert sstable.lookup(spark, folder, [2]).count() == 2
    assert sstable.lookup(spark, folder, [99]).count() == 0
    empty = shared_path(spark, "shards")
    assert materialise(sstable.write_shards(nothing, WORDS, empty), "manifest").count() == 0
    assert sstable.positions(spark, empty).count() == 0 and sstable.lookup(spark, empty, [1]).count() == 0


FOOTER = sstable.FOOTER.size


def test_a_table_finds_what_was_written(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as stream:
        writer = sstable.Writer(stream, 4)
        for i in range(0, 20000, 3):
            writer.add(sstable.encode_key(i - 5000), array("I", [i, i + 1]).tobytes())
        writer.finish()
    table = sstable.Table(path.read_bytes())
    assert len(table.blocks) > 3
    assert [x.tolist() for x in table.get(-5000 + 2997)] == [[2997, 2998]]
    assert table.get(-4999) == [] and table.get(None) == []
    assert sum(table.may_hold(i * 3 + 1 - 5000) for i in range(2000)) < 100
    broken = bytearray(path.read_bytes())
    broken[100] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Table(bytes(broken)).scan())
    broken[-FOOTER - 5] ^= 1
    with pytest.raises(ValueError):
        sstable.Table(bytes(broken))
