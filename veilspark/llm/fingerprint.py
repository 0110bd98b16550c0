"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

A sketch is the sorted array of the kept 64-bit hashes of a text's shingles (16 consecutive code points; a shorter text
is one shingle). As the threshold does not depend on the text, sketches merge by union and two texts of very unequal
length stay comparable: the share of the smaller sketch found in the larger one estimates containment. A text of which
no hash falls below the threshold keeps its least hash, so that only the empty text has an empty sketch; a merge drops
that hash again as soon as one below the threshold joins it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, range_bucket, shuffle_partitions, trimmed
from .hashing import mix64, power_table

SHINGLE = 16
#: One shingle hash in so many is kept.
SCALE = 16
EMPTY = np.empty(0, np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingle_hashes(points: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of ``width`` code points; of a shorter sequence, one hash; of none, none."""
    n = len(points)
    if n == 0:
        return EMPTY
    if n < width:
        powers, _ = power_table(n + 1)
        return mix64(np.array([(points.astype(np.uint64) * powers[1 : n + 1]).sum(dtype=np.uint64) ^ np.uint64(n)], np.uint64))
    powers, inverse = power_table(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points + np.uint32(1)).astype(np.uint64) * powers[:n], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * inverse[: n - width + 1])


def retain(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of a set of shingle hashes."""
    if not len(hashes):
        return EMPTY
    low = hashes[hashes < np.uint64((1 << 64) // scale)]
    return np.unique(low) if len(low) else hashes.min(keepdims=True)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two texts' shingles taken together."""
    return retain(np.concatenate([a, b]), scale)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the larger one has; 1 for two empty texts, 0 for one."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    return float((large[np.minimum(at, len(large) - 1)] == small).sum() / len(small))


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """``id_col, n_chars, fingerprint`` (base64 of the sketch) per row. Null text counts as empty; narrow."""

    @F.pandas_udf("string")
    def sketch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_text(retain(shingle_hashes(code_points(t or "")), scale)))

    return df.select(F.col(id_col), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"), sketch(F.coalesce(F.col(text_col), F.lit(""))).alias("fingerprint"))


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Each document beside its successor in descending id order (after the last: the first) and an edited text.

    The edit replaces the last ``n // 2`` code points by the first as many (or all) of the successor. Columns: ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Documents are dealt to ranges of ids and sorted; a task streams its range, and the greatest document of each range is
    also sent to the end of the range above. So whole texts move once, and neighbours are never joined.
    Null text counts as empty. A null id is the least of all. Rows that repeat an id follow each other by text. One row is
    its own successor. A very long text is fingerprinted whole; a worker holds it and its successor. An empty table gives
    an empty result. Other columns are ignored.
    """
    parts = shuffle_partitions(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bucket = range_bucket(docs, "doc_id", parts)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket)
    docs = docs.withColumn("bucket", bucket)
    # the greatest document of each range: at most one row per range reaches the driver, without its text
    heads = sorted(docs.groupBy("bucket").agg(F.max(F.struct("doc_id", F.sha2("text", 256).alias("h"))).alias("top")).collect(), key=lambda r: r["bucket"])
    if not heads:
        return df.sparkSession.createDataFrame([], OUTPUT)
    above = {r["bucket"]: heads[(i + 1) % len(heads)]["bucket"] for i, r in enumerate(heads)}
    to = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
    top = F.create_map(*[x for r in heads for x in (F.lit(r["bucket"]), F.struct(F.lit(r["top"]["doc_id"]).cast("long").alias("doc_id"), F.lit(r["top"]["h"]).alias("h")))])
    greatest = top[F.col("bucket")]
    is_top = F.col("doc_id").eqNullSafe(greatest["doc_id"]) & (F.sha2("text", 256) == greatest["h"])
    places = F.when(is_top, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("tail")), F.struct(to[F.col("bucket")].alias("b"), F.lit(1).alias("tail")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("tail"))))
    rows = docs.withColumn("place", F.explode(places)).select("doc_id", "text", F.col("place.b").alias("bucket"), F.col("place.tail").alias("tail"))
    rows = placed(rows, parts).sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.sha2("text", 256).desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        seen_tail = None
        for batch in batches:
            out = []
            for doc, text, b, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                points = code_points(text)
                here = (doc, b, points, shingle_hashes(points))
                if waiting is not None and waiting[1] == b and seen_tail != b:
                    out.append(_row(waiting, here, scale))
                if tail:
                    seen_tail, waiting = b, None
                else:
                    waiting = here
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=OUTPUT_NAMES)

    return rows.mapInArrow(trimmed(run), OUTPUT)


OUTPUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OUTPUT_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in OUTPUT.split(", ")]


def _row(here: tuple, following: tuple, scale: int) -> tuple:
    import hashlib

    doc, _, points, hashes = here
    _, _, next_points, next_hashes = following
    n = len(points)
    kept, put = n - n // 2, min(n // 2, len(next_points))
    edited = np.concatenate([points[:kept], next_points[:put]])
    whole = kept + put
    if whole < SHINGLE or kept < SHINGLE or put < SHINGLE:
        edited_hashes = shingle_hashes(edited)
    else:  # only the windows across the seam are new
        edited_hashes = np.concatenate([hashes[: kept - SHINGLE + 1], shingle_hashes(edited[kept - SHINGLE + 1 : kept + SHINGLE - 1]), next_hashes[: put - SHINGLE + 1]])
    a, e, b = retain(hashes, scale), retain(edited_hashes, scale), retain(next_hashes, scale)
    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return (doc, n, sha, to_text(a), to_text(e), containment(a, e), containment(a, b))
