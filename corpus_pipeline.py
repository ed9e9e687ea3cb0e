"""A training-corpus pipeline: five operators, each reading what the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet to the shared folder and reads it back as the
next stage's ``docs``.  All stages but the last return the columns of
``documents``; the last returns each document's token count and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from tidegauge.llm.shared import written


def _packed(docs: DataFrame) -> DataFrame:
    """Id, text, and all other columns in one struct, where no operator's result can take their names."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c not in ("doc_id", "text")]).alias("other"))


def _unpacked(rows: DataFrame, like: DataFrame, new_length: bool = False) -> DataFrame:
    """The columns of ``like``; after a cut, ``n_chars`` follows the text."""
    other = [c for c in like.columns if c not in ("doc_id", "text")]
    of = {c: F.col("other").getField(c).alias(c) for c in other} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if new_length and "n_chars" in other:
        of["n_chars"] = F.length("text").cast("long").alias("n_chars")
    return rows.select(*[of[c] for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from their labels, rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(toxicity.scored(_packed(docs), model).where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut; a document that held nothing else but white space goes with them."""
    cut = line_dedup.without_repeated_lines(_packed(docs), exact_chars=1)
    return _unpacked(cut.where(r"n_removed = 0 or text rlike '(?U)\\S'"), docs, new_length=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of each document."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]

#: A learned model and an edit-distance join cannot be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
