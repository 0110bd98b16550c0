"""Exact deduplication by salted digest groups (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Parts that one group of copies is dealt to; at most 63, since the parts in use travel as bits of a long.
SALTS = 32


def normalised(text: F.Column) -> F.Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Group rows whose normalised texts are identical; the smallest id of a group stays.

    One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Stages. (1) Each map task combines the copies it has read (partial aggregation on digest, salt and the whole
    text). (2) Salted digest groups merge: a group of copies is dealt to ``salts`` reducers, each of which compares
    whole texts. (3) The at most ``salts`` winners of a digest are combined globally, again on the whole text.
    (4) Rows find their group by (digest, salt), so the largest group is split over ``salts`` keys here, too.
    The digest is SHA-256 beside a 64-bit xxHash; texts are compared in full in stages 1 to 3.

    Null text equals empty text. A null id sorts after all others; a group of null ids only keeps null, with
    ``kept`` true. Rows that repeat both id and text belong to one group and share the verdict of that id. An empty
    table gives an empty result. Very long texts are compared whole, a row at a time. Other columns are ignored,
    whatever their names.
    """
    norm = normalised(F.col(text_col))
    base = df.select(F.col(id_col).alias("__id"), norm.alias("__t")).select(
        "__id",
        "__t",
        F.sha2(F.col("__t"), 256).alias("__d"),
        F.xxhash64("__t").alias("__x"),
        F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int").alias("__s"),
    )
    key = ["__d", "__x"]
    local = base.groupBy(*key, "__s", "__t").agg(F.min("__id").alias("__m"), F.count(F.lit(1)).alias("__n"))
    merged = local.groupBy(*key, "__t").agg(
        F.min("__m").alias("keep_id"),
        F.sum("__n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, __s)")).alias("__mask"),
    )
    groups = merged.select(
        *key,
        "keep_id",
        "group_size",
        F.explode(F.expr(f"filter(sequence(0, {salts - 1}), i -> (shiftright(__mask, i) & 1) = 1)")).alias("__s"),
    )
    rows = base.select("__id", *key, "__s")
    return rows.join(groups, [*key, "__s"]).select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("__d").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of rows with identical normalised texts one row, all columns: one with the group's least id.

    Rows are told apart by id and digest, so a copy goes even if another text under its id stays, and of rows that repeat
    both one stays. Texts move once: rows meet the verdict in the partitions in which their repeats were dropped.
    """
    key = lambda i: F.xxhash64(i, i.isNull())
    verdict = exact_dedup(df, id_col, text_col).where("kept").select(key(F.col(id_col)).alias("__i"), F.col("text_sha256").alias("__d")).distinct()
    rows = df.withColumn("__i", key(F.col(id_col))).withColumn("__d", F.sha2(normalised(F.col(text_col)), 256))
    return rows.dropDuplicates(["__d", "__i"]).join(verdict, ["__d", "__i"], "left_semi").drop("__i", "__d")
