"""Every registered query and every stage on tables of awkward rows, and what can be told by brute force of their results."""

import hashlib
import zlib
from array import array
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitalspark.llm import byte_bpe, hilbert, queries, simhash

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, score double, leaks string, bucket int",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string, evidence string",
    "conversations": "conv_id long, turn int, role string, text string, name string",
    "embeddings": "vec_id long, embedding array<float>, label int, filter long",
}
PASSAGE = "seven quiet rivers carry the old timber past the mill before the winter ice closes the narrow bridge again"


def awkward_rows():
    long = " ".join(f"word{i % 97} tail{i % 31}" for i in range(6000))
    texts = ["The cat sat on the mat and looked at the moon.", None, "", " \t\n ", long, "über straße café \U0001f642 漢字 don't we're 123 456", "x" * 5000, f"Some words come first, then {PASSAGE} and the rest follows here.", PASSAGE]
    docs = [(i, t, ["en", "de", None][i % 3], [None, "", "a", "src1"][i % 4], i, 1.0, "x", 1) for i, t in enumerate(texts + texts[:3])]
    docs += [(3, texts[0], "en", "a", 46, None, None, None)] * 2 + [(None, "orphan text without an identifier", "en", "a", 33, 0.0, "", 0), (None, None, None, None, None, None, None, None), (-5, "negative identifier", "xx", "a", None, None, None, None)]
    return {
        "documents": docs,
        "benchmark": [(1, PASSAGE), (1, PASSAGE), (2, None), (3, "two words"), (None, "never searched for at all")],
        "labels": [(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)],
        "pages": [(1, "https://a.example.de/x", "<html lang='de'><p>das ist ein haus</p></html>", "x"), (2, None, None, None), (None, "nonsense", "<p", ""), (4, "http://a.example.de", "", "y")] * 2,
        "conversations": [(1, 0, "user", "hello", "n"), (1, 1, "bob", "hi", "n"), (1, 1, "bob", "hi", "n"), (2, None, None, None, None), (None, 0, "system", "be kind", None), (3, 5, "ann", "x" * 4000, "n")],
        "embeddings": [(1, [1.0, 0.0, 0.5], 1, 7), (2, [1.0, 0.01, 0.5], 1, 7), (2, [1.0, 0.0, 0.5], 1, 7), (None, [1.0, 0.0, 0.5], 1, 7), (3, None, 1, 7), (4, [0.0, 0.0, 0.0], 1, 7), (5, [1.0, None, 0.5], 1, 7), (6, [float("nan"), 0.0, 0.5], None, 7), (7, [], 2, 7)],
    }


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for kind in ("awkward", "empty"):
        root = tmp_path_factory.mktemp(kind)
        for name, rows in awkward_rows().items():
            spark.createDataFrame(rows, TABLES[name]).where("true" if kind == "awkward" else "false").coalesce(2).write.parquet(f"{root}/{name}.parquet")
        made[kind] = str(root)
    return made


PER_ROW = {"op1_lattice_likelihood": "documents", "op2_counterfactual_toxicity": "documents", "op3_byte_bpe_tree": "documents", "op4_hilbert_shards": "documents", "op5_language_fusion": "pages", "op6_simhash_trie": "documents", "op7_sstable_shards": "documents", "op10_spherical_caps": "embeddings"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_query_takes_awkward_and_empty_tables(spark, folders, name):
    rows = queries.QUERIES[name](spark, folders["awkward"]).collect()
    given = awkward_rows()
    if name in PER_ROW:
        assert len(rows) == len(given[PER_ROW[name]])
        key = rows[0].__fields__[0]
        assert Counter(r[key] for r in rows) == Counter(x[0] for x in given[PER_ROW[name]])
    if name == "op8_latent_decontamination":
        assert sorted(r["doc_id"] for r in rows) == [7, 8] and {r["item_id"] for r in rows} == {1}
    assert queries.QUERIES[name](spark, folders["empty"]).count() == 0


def test_digests_equal_the_libraries(spark, folders):
    docs = Counter((d[0], d[1] or "") for d in awkward_rows()["documents"])
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = byte_bpe.read_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for (i, text), n in docs.items():
        ids = library.encode_ordinary(text)
        want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += n
    assert Counter(map(tuple, queries.op3_byte_bpe_tree(spark, folders["awkward"]).collect())) == want

    words, want, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    got = sorted(queries.op7_sstable_shards(spark, folders["awkward"]).collect(), key=lambda r: r["start"])
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    for i, text in docs.elements():
        ids = words.encode(text, add_special_tokens=False).ids + [2]
        want.append((i is not None, i or 0, len(ids), zlib.crc32(array("I", ids).tobytes())))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)
    listed = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert listed == sorted(listed)


def test_shards_of_the_query(spark, folders):
    docs = Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in awkward_rows()["documents"])
    rows = queries.op4_hilbert_shards(spark, folders["awkward"]).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == docs
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(len(slots.get(k, [])) for k in range(40)) <= 1
    curve = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert all(a["curve"] <= b["curve"] for a, b in zip(curve, curve[1:]) if a["shard"] != b["shard"])
    assert hilbert.BITS * 3 < 31


def test_fingerprints_and_components_of_the_query(spark, folders):
    docs = [(d[0], d[1] or "") for d in awkward_rows()["documents"]]

    def fingerprint(text):
        made = simhash.hashes(text, 4, 42)
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in made) > len(made)) if made else 0

    prints = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(docs, prints)))
    assert Counter(map(tuple, queries.op6_simhash_trie(spark, folders["awkward"]).collect())) == want


def test_stages_on_awkward_and_empty_tables(spark, folders):
    for kind in ("awkward", "empty"):
        docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folders[kind])
            assert kept.columns == docs.columns, name
            assert kept.exceptAll(docs).count() == 0, name
            if name == "decontamination" and kind == "awkward":
                gone = docs.exceptAll(kept)
                assert sorted(r["doc_id"] for r in gone.select("doc_id").collect()) == [7, 8]
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0


def test_the_pipeline_keeps_what_it_should(spark, tmp_path):
    tables = awkward_rows() | {"labels": [(i, 1, 0) for i in range(12)]}
    for name, rows in tables.items():
        spark.createDataFrame(rows, TABLES[name]).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    found = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect())
    # No label is toxic and no language is ruled out. Of equal texts the least key stays: 0 for 3, 3 and 9,
    # and 1 for all texts without words (2, 3, 10, 11 and a null key); 7 and 8 hold the benchmark's passage.
    assert found == Counter([None, -5, 0, 1, 4, 5, 6])


def test_scores_of_the_query(spark, folders):
    rows = queries.op2_counterfactual_toxicity(spark, folders["awkward"]).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = queries.table(spark, folders["awkward"], "documents").select("doc_id", F.coalesce(queries.bucket() == 0, F.lit(False)).alias("h")).distinct()
    assert {(r["doc_id"], r["held_out"]) for r in rows} == {tuple(r) for r in held.collect()}
    scored = queries.op1_lattice_likelihood(spark, folders["awkward"]).collect()
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in scored)
