"""From raw documents to training text in five stages, each one operator of furlong.llm.

Every stage takes (spark, docs, sf_dir), returns a DataFrame, and reads what the stage before it
kept. run() writes each stage's rows as Parquet to the shared folder and reads them again, so a
stage that is lost with its executors is repeated alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import decontamination, jaccard_join, language, pieces, secrets
from furlong.llm.vocabulary import model_path, read_model
from furlong.session import shared_dir


#: A document stays if it is this near to a learned language: 1 is its profile, 0 shares no n-gram with it.
LEAST_SCORE = 0.05


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those whose nearest profile is at LEAST_SCORE or more.

    Profiles are learned from the stage's own rows with a language, those kept from learning in
    op6 aside. Null texts, texts without a letter, and texts in a script or language that no profile
    knows go. Where no row has a language nothing can be learned, and every text with a letter stays.
    Each row is judged by its own text, whatever its id.
    """
    profiles = language.fit(language.training_rows(docs))
    if not profiles.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.tagged(docs, profiles)
    return found.filter(F.col("_score") >= LEAST_SCORE).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id; texts without a word stay."""
    return jaccard_join.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind; n_chars is that of the new text."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the piece ids of every text."""
    return pieces.encode(docs, read_model(model_path()))


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", as_pieces),
]

#: Language profiles, MinHash classes and the latent space are no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
