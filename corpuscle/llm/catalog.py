"""The thin queries over the driver's tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.best_fit_packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.pii import with_surrogates

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(documents)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuscle.llm.token_binary import token_binary

    return token_binary(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from corpuscle.llm.oracles import SQL

    return dict(SQL)
