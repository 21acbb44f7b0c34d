"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

1. ``quality``: documents that the classifier rejects go.
2. ``near_dedup``: one document of each group of near-duplicates (5-word shingles, similarity 0.8) stays.
3. ``decontaminate``: documents that hold a benchmark window go.
4. ``pii``: personal data in the texts is masked.
5. ``encode``: piece ids of every text, with the text decoded from them again.

The first four return the columns they get. SQL can express neither the classifier nor the tokenizer, so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.decontam import drop_contaminated
from panelspark.llm.minhash import drop_near_duplicates
from panelspark.llm.pieces import encode_pieces
from panelspark.llm.pii import mask_pii
from panelspark.llm.quality import keep_quality
from panelspark.llm.words import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose estimated probability of good quality is 0.7 or more."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates."""
    return drop_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten consecutive words of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked."""
    return mask_pii(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, piece_ids, n_pieces, round_trip``: the ids of every text; ``round_trip`` says that they decode to it."""
    import public_tokenizers

    encoded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), "text", "piece_ids", "round_trip")
    return encoded.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what a stage returns is written in the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
