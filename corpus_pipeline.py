"""A corpus pipeline of five stages, each of which calls one training-data operator.

``STAGES`` lists them in order; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.bpe import bpe_encode, ids_digest
from veilspark.llm.common import discard, free_name, materialize, python_operators, table
from veilspark.llm.exact_dedup import drop_copies
from veilspark.llm.mixing import mixture
from veilspark.llm.ngram_join import drop_linked
from veilspark.llm.queries import BYTE_VOCAB, vocab
from veilspark.llm.toxicity import is_toxic, score_documents, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no category of the chain rejects; the chain is fitted on the labelled documents of the input."""
    python_operators(spark)
    prefix = free_name(docs, "p_")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")), prefix=prefix)
    return scored.where(~is_toxic(scored, prefix)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle Jaccard, the document with the least id stays."""
    python_operators(spark)
    return drop_linked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is served."""
    return mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digest of what they decode to."""
    python_operators(spark)
    path = vocab(BYTE_VOCAB)
    done = bpe_encode(docs, path, decoded_col="decoded", drop=["text"])
    return done.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: The first stage is a fitted model: SQL has no equivalent. The tests compare the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each stage's result written to the shared folder."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, docs = kept, materialize(docs, f"pipeline-{name}")
            kept = docs
            discard(before)
    return docs
