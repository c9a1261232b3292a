"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, hamerly, hilbert, langid, lattice, simhash, spherical, sql, sstable, toxicity, url_tree, vector_codes
from .common import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(key: str = "doc_id"):
    """crc32 of the identifier as text, modulo 5: the folds that the queries hold out."""
    return F.crc32(F.col(key).cast("string")) % 5


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated rows and null keys too; null texts count as empty and have an end alone; a null key has no fold and is learnt from. An empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(bucket() == 1, F.lit(False))
    pieces = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    scored = lattice.score_documents(docs, pieces, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated rows and null keys too; null and empty texts get the model's bias; without labels every score is alike, below one half."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(bucket() != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model, drop=("text",))
    return scored.select("doc_id", F.coalesce(bucket() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page, repeated rows and null keys too; null or empty pages are judged by address and declaration, or by the prior alone."""
    model = langid.fit_text(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return langid.identify_pages(table(spark, sf_dir, "pages"), model)


def op3_byte_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated rows and null keys too; null texts count as empty: no ids, and the digests of nothing."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(spark, table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document in the order of null keys, then keys; repeated keys follow each other; null texts count as empty and hold the end id. An empty table gives an empty one."""
    folder = shared_path(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    sstable.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), folder).write.format("noop").mode("overwrite").save()
    return sstable.positions(spark, folder)


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated rows and null keys too; null and wordless texts have fingerprint 0 and link like any other; a null key names no component but one of null keys alone."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document and item that it holds, again for each repeated row; null texts hold nothing, null items and items of under four words aren't searched for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated rows and null keys too; null texts count no bytes, null metadata as the least; under 40 rows some shards are empty."""
    docs = table(spark, sf_dir, "documents")
    bytes_of = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", (bytes_of + 16).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source", "n_chars")
    dimensions = {name: F.col(name) for name in ("lang", "source", "n_chars")}
    made = hilbert.shard(rows, dimensions, 40, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a conversation, participant and turn; nulls, ties and repeated turns as chat.rotate says."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a vector, repeated rows and null keys too; what can't be compared links with nothing and is kept."""
    return spherical.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a usable vector, repeated rows and null keys too; others have no row; as hamerly.cluster says."""
    return hamerly.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_delta_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a usable vector, repeated rows and null keys too; others have no row; as vector_codes.encode says."""
    return vector_codes.encode(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


#: Rules of addresses; whether they allow, host, start of the path.
RULES = [(True, "com", "/"), (False, "example.com", "/en/"), (True, "www.example.com", "/en/"), (False, "net", "/es/"), (False, "net", "/fr/")]


def op13_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page, repeated rows and null keys too; null addresses have an empty host and path.

    Labels are of documents; a page shows the document whose number is the last in its path, and is
    bad if that is of quality 0 or toxic. A document labelled twice is bad if one label says so.
    """
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    told = labels.groupBy(F.col("doc_id").alias("doc")).agg(F.max(bad).alias("bad"))
    numbered = pages.select("url", F.regexp_extract(url_tree.path_of(F.col("url")), "([0-9]+)[^0-9]*$", 1).try_cast("long").alias("doc")).where("doc is not null")
    judged = url_tree.judge(pages, "page_id", "url", numbered.join(told, "doc").select("url", "bad"), RULES)
    return judged.withColumn("bad_share", F.round("bad_share", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_likelihood": op1_lattice_likelihood,
    "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
    "op5_language_fusion": op5_language_fusion,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op9_perspective_rotation": op9_perspective_rotation,
    "op3_byte_bpe_tree": op3_byte_bpe_tree,
    "op6_simhash_trie": op6_simhash_trie,
    "op7_sstable_shards": op7_sstable_shards,
    "op10_spherical_caps": op10_spherical_caps,
    "op8_latent_decontamination": op8_latent_decontamination,
    "op11_hamerly_clusters": op11_hamerly_clusters,
    "op12_delta_codes": op12_delta_codes,
    "op13_url_templates": op13_url_templates,
}

ORACLE_SQL: dict[str, str] = {
    "op9_perspective_rotation": """
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
 people AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
 seen AS (SELECT t.conv_id, participant, turn, role AS speaker, text AS content, CASE WHEN role = 'system' THEN 'system' WHEN role = participant THEN 'assistant' ELSE 'user' END AS chat_role FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
 made AS (SELECT *, '<|im_start|>' || CASE WHEN chat_role = 'user' THEN 'user name=' || speaker ELSE chat_role END || chr(10) || content || '<|im_end|>' || chr(10) AS rendered FROM seen),
 placed AS (SELECT *, row_number() OVER w - 1 AS place, sum(length(rendered)) OVER w AS upto FROM made WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, md5(speaker || chr(0) || content), speaker, content ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, place::BIGINT AS "position", turn, speaker, chat_role, CASE WHEN chat_role = 'user' THEN speaker END AS name, content, rendered, (upto - length(rendered))::BIGINT AS "start", upto::BIGINT AS "end", (chat_role = 'assistant')::INT AS learn FROM placed""",
    "op10_spherical_caps": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 usable AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 reached(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
 degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x),
 roots AS (SELECT x, min(y) AS y FROM reached GROUP BY x),
 named AS (SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id FROM embeddings LEFT JOIN degrees ON vec_id = degrees.x LEFT JOIN roots ON vec_id = roots.x)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM named""",
    "op11_hamerly_clusters": sql.clusters(),
    "op12_delta_codes": sql.codes(),
    "op13_url_templates": sql.url_verdicts(RULES, url_tree.LEVELS, url_tree.MANY, url_tree.APART, url_tree.DEVIATIONS, url_tree.WEIGHT, url_tree.PRIOR, url_tree.REJECT),
}
