"""The corpus pipeline: whole documents through quality rules, language ID, near-duplicate removal, decontamination and packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All stages but the last return the columns
of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import decontam, hostrules, langid, memory, packing, partenum, store
from ravelin.llm.queries import vocabulary

#: Posterior of the likeliest language below which a document is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Ids that are broadcast at most (some 32 bytes each in an executor); of more, Spark sorts both sides of the join.
MOST_BROADCAST = 2_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes; null texts go, repeated rows stay, an empty table stays empty."""
    return hostrules.kept_rows(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or without a clear language go. Repeated rows stay, and all go if
    no row has a language to learn."""
    model = langid.fit(docs.where(~langid.held_out()), vocabulary("piece_bpe_32k.model"))
    pred, score = (memory.free_name(docs.columns, x) for x in ("pred", "posterior"))
    found = langid.predict(docs, model, keep=docs.columns, names=(pred, score))
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id, and of rows with that id the one with the first text; documents
    without an id stay, as do null and empty texts, and an empty table stays empty."""
    groups = store.written(partenum.jaccard_groups(docs), "groups")
    gone = store.written(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    few = gone.count() <= MOST_BROADCAST
    rest = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    twice = store.written(groups.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return rest
    # minima combine before the shuffle, so an id on many rows is one row of each task
    first = rest.join(twice, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*docs.columns), "text").alias("row"), F.first(F.struct(*docs.columns)).alias("any"))
    return rest.join(twice, "doc_id", "left_anti").select(*docs.columns).union(first.select(F.coalesce("row", "any").alias("row")).select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: passages are cut out, and documents that are mostly passages go. Null and empty texts
    and repeated rows stay, and an empty table stays empty."""
    clean = decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; a null text is one piece with the end id, repeated
    rows are packed each on their own, and an empty table gives no rows."""
    return packing.packed_documents(docs, vocabulary("byte_bpe_50k.json")).drop("certified")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, set joins and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return docs
