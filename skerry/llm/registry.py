"""Queries of the corpus operators, and the SQL of those that SQL can express. One function for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import align, bpe, exactdedup, idfile, langid, mixing, ngramjoin, packing, prefixtrie, quality, secrets, toxicity, urlfilter
from skerry.llm.common import table
from skerry.llm.sql import ORACLES

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE_LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def crc_of_id() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    return bpe.decode(encoded, BYTE_BPE).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = toxicity.pick(labels.filter("toxic is not null").filter(F.pmod(crc_of_id(), F.lit(5)) != 0).select("doc_id", "toxic"))
    weights = toxicity.fit(docs.select("doc_id", "text").join(own, "doc_id").select("text", "toxic"))
    return toxicity.score(docs, weights).select(
        "doc_id", (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "sentences"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = idfile.write_ids(table(spark, sf_dir, "documents"), WORD_BPE)
    return (
        idfile.read_ids(files)
        .join(F.broadcast(idfile.starts(files)), "part")  # a row for each partition
        .select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", F.crc32("packed").alias("ids_crc32"))
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(table(spark, sf_dir, "documents"), owner=max)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.fit(docs.filter(F.pmod(crc_of_id(), F.lit(3)) != 1))
    return langid.classify(docs, dictionaries).select("doc_id", (F.pmod(crc_of_id(), F.lit(3)) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.clustered(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin(*secrets.BASE))
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, secrets.BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.nodes(prefixtrie.rebuilt(prefixtrie.sequences(table(spark, sf_dir, "conversations"))))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align.align(table(spark, sf_dir, "documents"), BYTE_BPE_LIBRARY, PIECE_BPE)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return align.count(aligned.withColumn("groups_sha256", digest), more=["groups_sha256"])


QUERIES = (op1_byte_bpe, op2_url_filters, op3_ngram_jaccard_join, op4_toxicity, op5_quality_rules, op6_token_id_output, op7_exact_dedup, op8_language_id, op9_best_fit_packing, op10_secret_scans, op11_mix_sources, op12_conversation_prefix_trie, op13_cross_tokenizer_alignment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
