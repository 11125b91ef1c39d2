"""A training corpus from ``documents``: quality, near-duplicates, secrets, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import bpe, mixing, neardup, quality, secret_scan
from casebook.llm.queries import QUERIES, vocabulary
from casebook.llm.store import forget, forget_paths, tables_noted, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on all labelled rows of ``docs`` up to its bound, scores 0.5 or more."""
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    docs = docs.select(*COLUMNS)
    model = quality.train(docs.select("doc_id", "text"), labelled)
    # the operator gives all columns but the text it reads
    scored = quality.score(docs.withColumn("_body", F.col("text")), model)
    return scored.where("score >= 0.5").withColumnRenamed("_body", "text").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return neardup.near_duplicates(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; every secret in a text is replaced by a mark, and ``n_chars`` follows."""
    found = secret_scan.scan(docs.select(*COLUMNS), out="_secrets")
    text = secret_scan.masked(F.col("text"), F.col("_secrets"))
    changed = F.size("_secrets") > 0
    return found.withColumns({"n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")),
                              "text": text}).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it; rows that it leaves out go."""
    mixed = mixing.mix(docs, carry=COLUMNS)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text back."""
    coded = bpe.encode_and_decode(docs.select(*COLUMNS), vocabulary())
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        same.alias("round_trip"))


STAGES = [
    ("quality_classifier", keep_good),
    ("near_dedup", keep_one_of_each),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("bpe_tokens", to_tokens),
]
# The classifier and the samples of near-dedup are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; once a stage is written, the one before it and the tables of its operators are deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with tables_noted() as own:
            result = stage(spark, docs, sf_dir)
        docs = written(result, name)
        forget_paths(spark, own)
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
