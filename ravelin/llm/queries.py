"""One query per operator over its whole table, at production parameters, with the digest columns of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import decontam, histsort, hostrules, htmltext, langid, licenses, oracles, packing, partenum, rans, secrets, spelling, vectorcodes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histsort.shards_by_bytes(_table(spark, sf_dir, "documents"))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, table, manifest = rans.write_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return rans.read_tokens(spark, folder, table, manifest)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()), vocabulary("piece_bpe_32k.model"))
    return langid.predict(docs.withColumn("held_out", langid.held_out()), model, keep=["doc_id", "held_out"])


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_groups(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_warc(_table(spark, sf_dir, "pages"))
    return warc.read_warc(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_crf_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judged(_table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontam.report(found)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(_table(spark, sf_dir, "embeddings"))


def op12_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_histogram_sort, op2_rans_tokens, op3_language_id, op4_ngram_jaccard, op5_warc, op6_diagonal_licenses, op7_crf_html, op8_host_rules, op9_best_fit_packing, op10_decontamination, op11_vector_codes, op12_markov_secrets, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
