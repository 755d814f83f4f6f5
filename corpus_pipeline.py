"""Corpus pipeline: documents through the stages of STAGES, each written as Parquet and reread.

Each stage gets all that the one before it kept. Stages whose Python code reads whole documents run with small
Arrow batches, a setting of the pipeline's session that no operator touches. All but the last return the columns of
documents. Nothing is gathered on the driver, and stage tables go to the shared folder that the
cluster names in spark.checkpoint.dir.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftwork.llm.line_dedup import line_dedup  # noqa: E402
from siftwork.llm.minhash_dedup import near_duplicates  # noqa: E402
from siftwork.llm.mixing import mix  # noqa: E402
from siftwork.llm.quality import quality_filter  # noqa: E402
from siftwork.llm.sentencepiece_codec import encode_documents  # noqa: E402
from siftwork.session import ensure_checkpoint_dir, small_batches, table  # noqa: E402


#: Similarity from which the near-dedup stage links, in percent; 85 is the contract of op1 alone.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards labelled good text draws."""
    small_batches(spark)
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text.

    A document that loses all its lines stays, with an empty text: later stages link it with
    nothing and encode it to no ids.
    """
    out = line_dedup(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.80 or more), its smallest doc_id."""
    small_batches(spark)
    gone = near_duplicates(docs.select("doc_id", "text"), percent=NEAR_PERCENT).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget says; each repetition is a row."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    small_batches(spark)
    return encode_documents(docs).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding", tokens),
]

#: Hashed models, permutations and the vocabulary can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            _delete(spark, f"{base}/{k - 1}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a stage table that the next stage has read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
