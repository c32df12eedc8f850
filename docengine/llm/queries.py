"""The subpackage's queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import audit, chat, fim, hamming, jaccard, langid, logbilinear, mixing, packing, pii, quality, rules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming.search(codes, codes.where(F.col("id") % 100 == 0))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


#: Shares of the tokens that the mix aims at, by domain.
TARGETS = {"good": 0.94, "low": 0.02, "toxic": 0.04}


def domains_of(labels: DataFrame) -> DataFrame:
    """The labelled table's marks as domains."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), TARGETS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive_pages(table(spark, sf_dir, "pages"))
    return made.withColumn("block", F.decode("block", "UTF-8"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs))


def op6_logbilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbilinear.scores(table(spark, sf_dir, "documents"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 6).alias("probability"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming": op1_hamming,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_logbilinear": op6_logbilinear,
    "op7_rules": op7_rules,
    "op8_chat": op8_chat,
    "op9_jaccard": op9_jaccard,
    "op10_pii": op10_pii,
    "op11_fim": op11_fim,
    "op12_audit": op12_audit,
    "op13_langid": op13_langid,
}

SQL: dict[str, str] = {
    "op1_hamming": hamming.SQL,
    "op8_chat": chat.SQL,
    "op11_fim": fim.SQL,
    "op12_audit": audit.SQL,
}
