"""A corpus pipeline: quality rules, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  Between
two stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimeframe.llm import exact_dedup, line_quality, mixing, sentencepiece_codec, simhash
from rimeframe.llm._store import Store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; then documents that are too short, repetitive or lost too much."""
    return line_quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) one stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles one stays."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.repeat_by_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row."""
    import public_tokenizers

    tokens = sentencepiece_codec.tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"))
    # Staged, since only a staged table is written with small Arrow batches; else a whole partition may come in one.
    return Store(spark, "encode").done(tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The rounding of the mix and the codec can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, store.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            store.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
