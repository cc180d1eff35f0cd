"""The queries of this subpackage, over the tables of a folder, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprints, langid, negatives, oracles, phrases, quality, reshard, rules, secrets, simhash, suffixes, variants

TOKENIZER = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path(TOKENIZER))
    return bpe.encode_documents(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, quality.graded(table(spark, folder, "labels")))
    return quality.score(docs, model).select("doc_id", "quality_verdict.*")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_reshard(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(reshard.SHARDS))
    return reshard.reshard(docs, old).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op5_rules(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rules.judged(table(spark, folder, "documents")).select("doc_id", *columns)


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def op8_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.digest(table(spark, folder, "documents"))


def op9_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digest(table(spark, folder, "documents"))


def op10_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    trees = langid.train(docs.where(~held_out & F.col("lang").isNotNull()))
    found = langid.identify(docs, trees)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, folder, "embeddings"), F.col("vec_id"), label, F.col("embedding"), F.col("vec_id") % 100 == 0)


def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.compared(table(spark, folder, "documents"))
    return found.withColumns({c: fingerprints.hexadecimal(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_decontaminate, op4_reshard, op5_rules, op6_simhash, op7_secrets, op8_phrases, op9_suffixes, op10_langid, op11_negatives, op12_fingerprints, op13_variants)}

ORACLES = {"op3_decontaminate": oracles.DECONTAMINATE_SQL, "op5_rules": oracles.RULES_SQL, "op8_phrases": oracles.PHRASES_SQL, "op9_suffixes": oracles.SUFFIXES_SQL, "op11_negatives": oracles.NEGATIVES_SQL, "op13_variants": oracles.VARIANTS_SQL}
