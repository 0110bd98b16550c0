"""Sources: bundled tables, prompts with validation, lexicons, audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMPT = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("text", T.StringType()), T.StructField("apply_noise", T.BooleanType())])

MAX_LEXICON = 100_000
#: Below so many bytes a core, a table is dealt anew.
SPLIT_BYTES = 32 << 20

#: Given and family names of our own choosing.
LEXICON = (
    "Alice", "Amara", "Anders", "Bruno", "Carla", "Chen", "Deepika", "Diego", "Elena", "Fatima", "Garcia", "Greta",
    "Haruto", "Ibrahim", "Ingrid", "Ivan", "Johansson", "Kofi", "Kumar", "Lars", "Leila", "Maria", "Mehta", "Nguyen",
    "Novak", "Okafor", "Olga", "Pedro", "Petrov", "Priya", "Rahul", "Rossi", "Sharma", "Silva", "Sofia", "Tanaka",
    "Tomas", "Verma", "Wei", "Yusuf", "O'Brien", "Jean-Luc",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files have fewer row groups than that; large tables stay as they are read.

    Text operators take far longer than the move of a table this small. Row groups are what a scan can be split by, and
    files below one block seldom have several, so the files' size decides.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def prompts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Prompt rows of a fixed schema; ``apply_noise`` defaults to true."""
    return spark.read.schema(PROMPT).format(fmt).load(path).withColumn("apply_noise", F.coalesce("apply_noise", F.lit(True)))


def stream_prompts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(PROMPT).format(fmt).load(path)


def lexicon(spark: SparkSession, path: str) -> list[str]:
    """Words of a text file, one a line; blank lines and ``#`` comments are skipped.

    For lists that fit a literal: more than ``MAX_LEXICON`` words are an error, none is dropped.
    """
    rows = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> '' and not startswith(w, '#')").distinct()
    words = [r["w"] for r in rows.limit(MAX_LEXICON + 1).collect()]
    if len(words) > MAX_LEXICON:
        raise ValueError(f"a lexicon has at most {MAX_LEXICON} words")
    return sorted(words)


def rejection(text: F.Column, limit: int = 10_000) -> F.Column:
    """Why a prompt is not admitted, or null."""
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit("blank")).when(F.length(text) > limit, F.lit("too long"))


def write_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows, partitioned by day."""
    rows.withColumn("dt", F.to_date("created_at")).write.mode("append").partitionBy("dt").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def completion_text(body: F.Column) -> F.Column:
    """The answer within a chat-completion body; null where there is none, which counts as unavailable."""
    return F.get_json_object(body, "$.choices[0].message.content")
