"""A corpus pipeline of five stages: each keeps, drops or changes documents for the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between stages the documents are written and read again, so a lost executor costs one stage at
most and each stage's plan stands alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, mixing, quality_gbt, quality_rules, sentencepiece_bpe
from tessera.llm.common import bounded, materialize, release, scratch_made
from tessera.llm.queries import tokenizer_path


_EARLIER: list[str] = []


def _stage(f):
    """The stage with small Arrow batches. Scratch tables of the stage before go first: its result is written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_EARLIER, docs)
        before = set(scratch_made())
        out = f(bounded(spark), docs, sf_dir)
        _EARLIER[:] = [path for path in scratch_made() if path not in before]
        return out

    return run


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of these documents and drops those it rates low."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_gbt.accepted(docs, quality_gbt.train_on_documents(docs, labels, quality_gbt.learnable()))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie far from their language's and source's others."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs, shingle=5, num=80, den=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps, cuts or drops documents so that sources have their target shares."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix."""
    ids = sentencepiece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"), "text", ids="ids")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", _stage(quality_classifier)),
    ("quality rules", _stage(quality_rules_stage)),
    ("n-gram Jaccard join", _stage(near_duplicates)),
    ("mixing sources to target weights", _stage(source_mix)),
    ("SentencePiece encoding", _stage(tokens)),
]

#: Trained trees, iterated estimates and classes of linked documents are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
