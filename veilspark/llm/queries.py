"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode, ids_digest
from .common import scratch_dir, python_operators, table
from .exact_dedup import exact_dedup
from .fingerprint import neighbour_fingerprints
from .html_wrappers import extract_main_text
from .mixing import mix_sources
from .ngram_join import ngram_components
from .suffix_dedup import remove_repeats
from .token_files import read_token_files, write_token_files
from .toxicity import is_toxic, score_documents, train
from .warc import crawl_of, resolve_revisits

BYTE_VOCAB = "byte_bpe_50k.json"
WORD_VOCAB = "word_bpe_49k.json"


def vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_operators(spark)
    found = resolve_revisits(crawl_of(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical", "ts", "outcome", "source_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers")))).alias("headers"), "payload_digest")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_operators(spark)
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_operators(spark)
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_operators(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
    rounded = [F.round(c, 6).alias(c) for c in scored.columns if c.startswith("p_")]
    return scored.select("doc_id", *rounded, is_toxic(scored).alias("toxic"))


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    python_operators(spark)
    path = path or vocab(BYTE_VOCAB)
    done = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded", drop=["text"])
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_operators(spark)
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_operators(spark)
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    python_operators(spark)
    files = f"{scratch_dir(spark).rstrip('/')}/veilspark/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), files, path or vocab(WORD_VOCAB), 1)
    back = read_token_files(spark, files)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_html_text": op3_html_text,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_fingerprint": op7_fingerprint,
    "op8_ngram_join": op8_ngram_join,
    "op9_mixing": op9_mixing,
    "op10_token_files": op10_token_files,
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE: dict[str, str] = {
    "op1_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         sha256('mix:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(k % 3 + 1)::INT] AS w, source_size * 2 AS cap FROM k),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
        - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS lv FROM l),
t AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, lv * w) END AS target FROM f),
c AS (SELECT d.*, t.source_size, t.target,
        sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT c.*, e, CASE WHEN target > 0 THEN (e * source_size + cum)::DOUBLE / target END AS v
      FROM c, (SELECT unnest([0, 1]) AS e)),
r AS (SELECT *, sum(size) OVER (ORDER BY v, coalesce(source, ''), source IS NULL, h, doc_id, e ROWS UNBOUNDED PRECEDING) AS run
      FROM v WHERE v IS NOT NULL)
SELECT c.doc_id, c.size, c.source_size, c.target,
       coalesce(sum(CASE WHEN run <= (SELECT sum(size) FROM d)::DOUBLE * 1.5 THEN r.size END), 0)::BIGINT AS taken
FROM c LEFT JOIN r ON r.doc_id IS NOT DISTINCT FROM c.doc_id AND r.source IS NOT DISTINCT FROM c.source
GROUP BY ALL""",
}
