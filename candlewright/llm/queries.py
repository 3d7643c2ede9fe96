"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm import bpe, grading, merkle, multiprobe, near_vectors, packing, pages, repair, repeats, segment, sharding, shingle_join, toxicity
from candlewright.llm.common import table


def held_out(fold: int = 1) -> F.Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == fold


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed collection of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.encode_top_k(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), k=2)


def op2_pstable_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link(table(spark, sf_dir, "embeddings"))


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join_documents(table(spark, sf_dir, "documents"), k=4, threshold=(85, 100))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = grading.train(docs, labels.where(~held_out()))
    return grading.grade(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", "keep")


def op8_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_anchored_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)


def op10_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out()))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_lr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("id", "conv_id")


def op12_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    tokens = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_slot_pivot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    found = merkle.manifest(merkle.leaves_of(docs, tampered, F.translate("text", "\n", "")), fanout=3)
    root = merkle.folded(F.col("seen"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_gumbel_segmentations": op1_gumbel_segmentations,
    "op2_pstable_near_vectors": op2_pstable_near_vectors,
    "op3_page_differencing": op3_page_differencing,
    "op4_best_two_fit": op4_best_two_fit,
    "op5_stratified_interleaving": op5_stratified_interleaving,
    "op6_shingle_join": op6_shingle_join,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_multiprobe_search": op8_multiprobe_search,
    "op9_anchored_repeats": op9_anchored_repeats,
    "op10_ftrl_toxicity": op10_ftrl_toxicity,
    "op11_lr_repair": op11_lr_repair,
    "op12_segment_tree_bpe": op12_segment_tree_bpe,
    "op13_slot_pivot_manifest": op13_slot_pivot_manifest,
}

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_pstable_near_vectors": """
WITH RECURSIVE v AS (
 SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS n FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([e FOR e IN embedding IF NOT coalesce(isfinite(e), false)]) = 0) WHERE list_inner_product(x, x) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN link e ON e.a = r.b)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY ALL) USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY ALL) USING (vec_id)""",
    "op6_shingle_join": f"""
WITH RECURSIVE d AS (
 SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (
 SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 2, 2))) t(i) WHERE len(w) > 0),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY ALL),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
 SELECT a, b FROM both_ JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN sz USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY ALL) USING (doc_id)""",
    "op9_anchored_repeats": f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM d, unnest(range(1, len(w) - 33)) t(i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, j FROM hit, unnest(range(i, i + 35)) t(j)),
kept AS (SELECT doc_id, j, x FROM (SELECT doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) t(j)) p ANTI JOIN gone USING (doc_id, j)),
txt AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS k FROM kept GROUP BY ALL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN txt USING (doc_id)""",
}
