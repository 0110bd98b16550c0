"""Detection, redaction and restoration over DataFrames of texts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Vault
from ..functions import rules as R
from ..functions.crypto import TEST_KEY, placeholder
from ..functions.spans import SPAN, exploded, name_spans, rebuild, resolve, rule_spans
from ..sources.tables import LEXICON


def neutralise(text: F.Column) -> F.Column:
    """Look-alikes of placeholders in the input become inert."""
    return F.regexp_replace(text, R.PLACEHOLDER, R.REDACTED.replace("[", r"["))


def with_spans(df: DataFrame, text_col: str = "text", lexicon=LEXICON, ner=None, which: list[int] | None = None) -> DataFrame:
    """Adds ``spans``: the findings of rules, the optional NER hook and the lexicon, unresolved.

    ``ner`` maps a text column to an array of spans (``functions.spans.SPAN``), for example an Arrow UDF that loads a
    model once per worker; without it there are no such findings. Null texts have none. Narrow: nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [rule_spans(text, which)]
    if ner is not None:
        parts.append(F.coalesce(ner(text), F.expr(f"cast(array() as array<{SPAN}>)")))
    if lexicon:
        parts.append(name_spans(text, list(lexicon)))
    return df.withColumn("spans", F.concat(*parts))


def findings(df: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """One row per span: id, start, end, type, value, detector, priority, ord."""
    return exploded(df, F.col(spans_col), id_col).select(id_col, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "s.type", "s.value", "s.detector", (-F.col("s.negPriority")).alias("priority"), F.col("s.ord").alias("ord"))


def contested(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pairs of findings of one text that overlap, each once. Pairs are formed within a row: nothing is shuffled."""
    a, b = F.col("a"), F.col("b")
    rows = df.select(id_col, "spans", F.posexplode("spans").alias("i", "a")).select(id_col, "a", F.explode(F.slice("spans", F.col("i") + 2, F.size("spans"))).alias("b"))
    return rows.where((a["start"] < b["end"]) & (b["start"] < a["end"])).select(id_col, a["start"].alias("start_a"), a["end"].alias("end_a"), a["type"].alias("type_a"), b["start"].alias("start_b"), b["end"].alias("end_b"), b["type"].alias("type_b"))


def redact(df: DataFrame, id_col: str = "doc_id", session_col: str = "session_id", text_col: str = "text", lexicon=LEXICON, ner=None, cfg: Vault = Vault(), key: bytes = TEST_KEY, which: list[int] | None = None) -> DataFrame:
    """Neutralise, detect, resolve and replace: adds ``spans`` (resolved), ``redacted``, ``truncated``, ``issued``.

    Placeholders are computed from the key, so no vault is joined and nothing is shuffled. A session's capacity only
    matters to a text with more findings than that; see :func:`redact_with_capacity`, which ranks a session's values.
    """
    df = df.withColumn("__clean", neutralise(F.coalesce(F.col(text_col), F.lit(""))))
    df = with_spans(df, "__clean", lexicon, ner, which).withColumn("spans", resolve(F.col("spans")))
    token = lambda s: placeholder(F.col(session_col), s["type"], s["value"], key, cfg.letters)
    return df.withColumn("redacted", rebuild(F.col("__clean"), F.col("spans"), token)).withColumn("issued", F.size("spans")).withColumn("truncated", F.lit(False)).drop("__clean")


def redact_with_capacity(df: DataFrame, id_col: str = "doc_id", session_col: str = "session_id", text_col: str = "text", lexicon=LEXICON, cfg: Vault = Vault(), key: bytes = TEST_KEY, which: list[int] | None = None, storage: StorageLevel | None = None) -> DataFrame:
    """As :func:`redact`, with at most ``cfg.max_values`` distinct values of a session reversible.

    Within a text substitution goes from right to left, so the values that occur last are the ones that fit; texts of a
    session count by descending id. Other values become ``[TYPE_REDACTED]``. One shuffle of distinct values by session.
    Spans are used three times; with ``storage`` they are kept at that level.
    """
    df = df.withColumn("__clean", neutralise(F.coalesce(F.col(text_col), F.lit(""))))
    df = with_spans(df, "__clean", lexicon, None, which).withColumn("spans", resolve(F.col("spans")))
    if storage is not None:
        df = df.persist(storage)
    values = exploded(df, F.col("spans"), session_col, id_col).groupBy(session_col, F.col("s.type").alias("type"), F.col("s.value").alias("value")).agg(F.max(F.struct(id_col, F.col("s.start"))).alias("last"))
    rank = F.row_number().over(Window.partitionBy(session_col).orderBy(F.col("last").desc()))
    over = values.withColumn("__r", rank).where(F.col("__r") > cfg.max_values).select(F.col(session_col).alias("__s"), "type", "value")
    beyond = exploded(df, F.col("spans"), id_col, session_col).join(over, (F.col(session_col) == F.col("__s")) & (F.col("s.type") == F.col("type")) & (F.col("s.value") == F.col("value")), "left_semi")
    beyond = beyond.groupBy(F.col(id_col).alias("__i")).agg(F.collect_set(F.col("s.start")).alias("__over"))
    df = df.join(beyond, F.col(id_col) == F.col("__i"), "left").withColumn("__over", F.coalesce("__over", F.expr("cast(array() as array<int>)")))
    gone = lambda s: F.array_contains(F.col("__over"), s["start"])
    token = lambda s: F.when(gone(s), F.concat(F.lit("["), s["type"], F.lit("_REDACTED]"))).otherwise(placeholder(F.col(session_col), s["type"], s["value"], key, cfg.letters))
    out = df.withColumn("redacted", rebuild(F.col("__clean"), F.col("spans"), token))
    return out.withColumn("truncated", F.size("__over") > 0).withColumn("issued", F.size("spans") - F.size("__over")).drop("__clean", "__over", "__i")


def vault(df: DataFrame, session_col: str = "session_id", cfg: Vault = Vault(), key: bytes = TEST_KEY) -> DataFrame:
    """(session_id, type, value, token): the reversible values of redacted rows. Sensitive; written only on request."""
    rows = exploded(df, F.col("spans"), F.col(session_col).alias("session_id")).select("session_id", "s.type", "s.value").distinct()
    return rows.withColumn("token", placeholder(F.col("session_id"), F.col("type"), F.col("value"), key, cfg.letters))


def token_mentions(df: DataFrame, id_col: str, text_col: str, session_col: str = "session_id") -> DataFrame:
    """One row per placeholder in a text: its row's id as ``__id``, session, token and position."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(R.PLACEHOLDER), F.lit(0))
    return df.select(F.col(id_col).alias("__id"), F.col(session_col).alias("session_id"), F.posexplode(tokens).alias("pos", "token"))


def unknown_tokens(df: DataFrame, vault_rows: DataFrame, id_col: str = "doc_id", text_col: str = "output", session_col: str = "session_id") -> DataFrame:
    """Placeholders, repeats included, that the row's own session never issued."""
    return token_mentions(df, id_col, text_col, session_col).join(vault_rows.select("session_id", "token"), ["session_id", "token"], "left_anti").select(F.col("__id").alias(id_col), "session_id", "token", "pos")


def restore(df: DataFrame, vault_rows: DataFrame, id_col: str = "doc_id", text_col: str = "output", session_col: str = "session_id") -> DataFrame:
    """(id, restored, restored_count, unknown_count): placeholders of the own session become their values, literally.

    Only texts with placeholders are joined; the vault meets them by (session, token). Null output restores to "".
    """
    mentions = token_mentions(df, id_col, text_col, session_col)
    found = mentions.join(vault_rows.select("session_id", "token", "value"), ["session_id", "token"], "left")
    per_row = found.groupBy(F.col("__id").alias("__i")).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "value"))).alias("__m"), F.count("value").alias("__k"), F.count_if(F.col("value").isNull()).alias("__u"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = df.select(id_col, text.alias("__t")).join(per_row, F.col(id_col) == F.col("__i"), "left")
    gaps = F.split("__t", R.PLACEHOLDER, -1)
    body = F.aggregate(F.zip_with(F.slice(gaps, 2, F.size(gaps)), "__m", lambda g, m: F.struct(g.alias("g"), m.alias("m"))), F.element_at(gaps, 1), lambda a, x: F.concat(a, F.coalesce(x["m"]["value"], x["m"]["token"]), x["g"]))
    return joined.select(id_col, F.when(F.col("__m").isNull(), F.col("__t")).otherwise(body).alias("restored"), F.coalesce("__k", F.lit(0)).alias("restored_count"), F.coalesce("__u", F.lit(0)).alias("unknown_count"))


def generated_types(spans: F.Column) -> F.Column:
    """Distinct types that a model's own output shows, in rule order; look at the output before restoration."""
    return F.array_distinct(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["ord"].alias("o"), s["start"].alias("b"), s["type"].alias("t")))), lambda s: s["t"]))


def highest_severity(types: F.Column) -> F.Column:
    """The greatest severity among an array of types; 0 of none."""
    table = F.create_map(*[F.lit(x) for pair in R.ENTITY_TYPES for x in pair])
    return F.coalesce(F.array_max(F.transform(types, lambda t: table[t])), F.lit(0))


def counts_by_type(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return exploded(df, F.col("spans.type"), id_col, name="type").groupBy(id_col, "type").agg(F.count(F.lit(1)).alias("n"))


def summary(types: F.Column) -> F.Column:
    """``TYPE=n, TYPE=n`` in the order of the types, or ``none``."""
    def number(t: str) -> F.Column:
        return F.size(F.filter(types, lambda x: x == F.lit(t)))

    parts = [F.when(number(t) > 0, F.concat(F.lit(f"{t}="), number(t).cast("string"))) for t, _ in R.ENTITY_TYPES]
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("")), F.lit("none"))
