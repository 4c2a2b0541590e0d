"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_text, id_files, lexical_search, licenses, oracles, packing, pii, quality, secrets, toxicity, urls
from .ngram_join import near_duplicates


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.benchmark_hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urls.judge(_read(spark, sf_dir, "pages"), outcomes)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(_read(spark, sf_dir, "documents")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_read(spark, sf_dir, "documents"))


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.read_ids(id_files.write_ids(_read(spark, sf_dir, "documents"), tokenizer_path()))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that nothing is learned for."""
    return op3_quality_rules(spark, sf_dir).drop("kept")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that nothing is learned for."""
    return op8_pii(spark, sf_dir).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_pii": op8_pii,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op11_id_files": op11_id_files,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
    "quality_base": quality_base,
    "pii_base": pii_base,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": oracles.NGRAM_JOIN,
    "op2_decontamination": oracles.DECONTAMINATION,
    "op7_url_filter": oracles.URL_FILTER,
    "op10_secret_scan": oracles.SECRET_SCAN,
    "op12_lexical_search": oracles.LEXICAL_SEARCH,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
    "quality_base": oracles.QUALITY_BASE,
    "pii_base": oracles.PII_BASE,
}
