"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import additive_quant, bag_minhash, html_extract, language_mixture, merkle_manifest, packing, period_runs, quality_classifier, quality_rules, segment_sampling, sharding, token_counts, toxicity
from rasterloom.llm.common import id_bucket, table

#: Bytes of text that one shard may hold.
SHARD_LIMIT = 1 << 20


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def _predicted(scored: DataFrame, held_out) -> DataFrame:
    """Adds the fold of a row and its label at 0.3; a null id lies in no fold."""
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 4) == 2
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _predicted(toxicity.score(docs, model), held_out)


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_segment_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = segment_sampling.sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2, decoded=True)
    size, digests = (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), [F.crc32("ids").alias("ids_crc32"), F.crc32("text").alias("text_crc32")]
    return drawn.select("doc_id", "sample", size, *digests, "log_prob", "perturbed", "inclusion")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_counts(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 5) == 0
    model = quality_classifier.quality_model(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _predicted(quality_classifier.score(docs, model), held_out)


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quant.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_LIMIT)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify(table(spark, sf_dir, "documents"), merkle_manifest.lower_cased(F.col("doc_id")))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.periodic_runs(table(spark, sf_dir, "documents"), loop=True)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat_ws("", F.transform(lines, lambda s: F.concat(s, F.lit("\n"))))
    digests = [F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def op13_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(id_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    found = language_mixture.identify(docs, language_mixture.language_model(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_toxicity, op4_bag_minhash, op5_segment_sampling, op6_quality_rules, op7_html_extraction, op8_quality_classifier, op9_additive_quantisation, op10_sharding, op11_merkle_manifest, op12_period_runs, op13_language_mixture)}

SQL = {"op6_quality_rules": quality_rules.rules_sql(), "op10_sharding": sharding.shard_sql(SHARD_LIMIT), "op11_merkle_manifest": merkle_manifest.manifest_sql()}
