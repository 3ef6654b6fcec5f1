"""The queries of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolytics.llm import importance, ngram_join, quality_rules, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.warc import read_archives, write_archives

    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.tokenfiles import read_documents, write_tokens

    return read_documents(write_tokens(table(spark, sf_dir, "documents")))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.substring import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.importance import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.ngram_join import linked_documents

    return linked_documents(table(spark, sf_dir, "documents"))


def op13_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repolytics.llm.schema_drift import evolve

    return evolve(table(spark, sf_dir, "clients"))


QUERIES = {
    "op4_decontaminate": op4_decontaminate,
    "op2_extract": op2_extract,
    "op7_warc": op7_warc,
    "op5_rules": op5_rules,
    "op1_langid": op1_langid,
    "op8_quality": op8_quality,
    "op3_packing": op3_packing,
    "op10_tokens": op10_tokens,
    "op6_substring": op6_substring,
    "op9_simhash": op9_simhash,
    "op11_resample": op11_resample,
    "op12_jaccard": op12_jaccard,
    "op13_drift": op13_drift,
}

ORACLE_SQL: dict[str, str] = {"op5_rules": quality_rules.ORACLE, "op6_substring": substring.ORACLE, "op7_warc": warc.ORACLE, "op11_resample": importance.ORACLE, "op12_jaccard": ngram_join.ORACLE}
