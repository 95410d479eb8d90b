"""From raw documents to packed training bins, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet into the
shared folder and reads it again for the next. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import common, ordinal, packing, parity_join, pii, queries, raking


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model rejects."""
    session.ship(spark)
    model = ordinal.fit(docs, queries.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), label="grade")
    return ordinal.grade(docs, model).where("not rejected").select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the one of smallest id) of each class of 5-word shingle Jaccard >= 0.8; of rows that
    repeat an id the one of smallest text hash stays. Null ids stay: they are linked with nothing."""
    session.ship(spark)
    rows = parity_join.classes(docs).where("doc_id is not null")
    gone = common.cut(rows.where("doc_id != component_id").select("doc_id").distinct(), "pipeline-gone")
    few = gone.count() <= parity_join.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        return kept
    one = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))).alias("row")
    rest = kept.where("doc_id is not null").groupBy("doc_id").agg(one).select("row.*")
    return rest.unionByName(kept.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text."""
    out = pii.replace(docs, queries.PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled to the target weights."""
    return queries.mix(docs).where("rake_kept").select(docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    session.ship(spark)
    return packing.pack(docs, "doc_id", raking.tokens(F.col("text")), F.col("source"), packing.copy_cluster(F.col("text")))


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("pii", personal_data), ("mixing", mixing), ("packing", best_fit)]
#: A fitted model and a greedy packing are beyond SQL; tests/llm/test_pipeline.py checks each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
