"""The whole flow over prompts, its audit rows, metrics and reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import noise as N
from ..functions import rules as R
from ..functions import screening as S
from ..functions.crypto import TEST_KEY, prompt_fingerprint
from ..functions.spans import exploded
from ..operators import detection as D
from ..operators import stateful as K


def process(prompts: DataFrame, cfg: Settings = Settings(), key: bytes = TEST_KEY, prediction: tuple[str, str] | None = None, id_col: str = "session_id") -> DataFrame:
    """Screen, redact and perturb (session_id, subject, ts, text, apply_noise), in that order.

    ``id_col`` tells rows apart; it is another column where a session has several prompts. Adds ``verdict, spans,
    redacted, truncated, noised, epsilon, budget_allowed, noise_skipped_reason, outbound``. Blocked rows are not redacted:
    their spans are empty and their texts null. Values beyond a session's capacity are redacted irreversibly. The budget
    is charged by subject in order of time; a spent budget sends numbers as they are, or nothing under ``fail_closed``.
    """
    label, confidence = (F.col(c) for c in prediction) if prediction else (F.lit(None).cast("string"), F.lit(None).cast("double"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = prompts.withColumn("verdict", S.verdict(S.first_rule(text), label, confidence, cfg.screening.threshold, cfg.screening.fail_closed))
    clear = F.when(~F.col("verdict.attack"), F.col("text"))
    # kept, since the capacity, the ledger, the texts and the reports all start here; a lost block is computed again
    kept = StorageLevel.MEMORY_AND_DISK
    rows = D.redact_with_capacity(rows.withColumn("__clear", clear), id_col, "session_id", "__clear", cfg=cfg.vault, key=key, storage=kept).drop("__clear")
    rows = rows.withColumn("__n", N.apply_noise(F.col("redacted"), F.col(id_col), cfg.noise, key)).persist(kept)
    asked = F.coalesce("apply_noise", F.lit(True))
    wants = asked & ~F.col("verdict.attack") & F.lit(cfg.noise.enabled)
    rows = rows.withColumn("__cost", F.when(wants, F.col("__n.epsilon")).otherwise(F.lit(0.0)))
    ledger = K.budget_decisions(rows.where("__cost > 0").select(F.col(id_col).alias("__s"), "subject", "ts", "__cost"), "subject", "ts", "__s", "__cost", cfg.noise).select("__s", F.col("allowed").alias("__ok"))
    rows = rows.join(ledger, F.col(id_col) == F.col("__s"), "left")
    ok = wants & F.coalesce("__ok", F.lit(True))
    rows = rows.withColumn("budget_allowed", F.coalesce("__ok", F.lit(True))).withColumn("noised", F.when(ok, F.col("__n.noised")).otherwise(0)).withColumn("epsilon", F.when(ok, F.col("__n.epsilon")).otherwise(F.lit(0.0)))
    blocked = F.col("verdict.attack")
    spent = wants & ~F.coalesce("__ok", F.lit(True))
    reason = F.when(blocked, "blocked").when(~asked, "opted out").when(~F.lit(cfg.noise.enabled), "disabled").when(spent, "budget")
    held_back = spent & F.lit(cfg.noise.fail_closed)
    rows = rows.withColumn("noise_skipped_reason", reason)
    rows = rows.withColumn("outbound", F.when(~blocked & ~held_back, F.when(ok, F.col("__n.text")).otherwise(F.col("redacted"))))
    return rows.withColumn("redacted", F.when(~blocked, F.col("redacted"))).drop("__n", "__cost", "__s", "__ok")


def audit(done: DataFrame, key: bytes = TEST_KEY, keep_raw: bool = False) -> DataFrame:
    """The audit table of processed prompts; ``output`` may mark unavailable models by null."""
    blocked = F.col("verdict.attack")
    failed = F.col("output").isNull() & ~blocked if "output" in done.columns else F.lit(False)
    return done.select(
        "session_id",
        prompt_fingerprint(F.col("text"), key).alias("prompt_fingerprint"),
        F.coalesce(F.length("text"), F.lit(0)).alias("prompt_length"),
        F.col("outbound").alias("redacted_prompt"),
        (F.col("text") if keep_raw else F.lit(None).cast("string")).alias("raw_prompt"),
        F.when(~blocked, D.summary(F.col("spans.type"))).alias("pii_summary"),
        blocked.alias("attack_detected"),
        F.col("verdict.method").alias("detection_method"),
        F.col("verdict.rule").alias("detection_rule"),
        F.when(blocked, F.col("verdict.confidence")).otherwise(F.lit(0.0)).alias("detection_confidence"),
        F.when(blocked, "BLOCKED").when(failed, "LLM_UNAVAILABLE").otherwise("OK").alias("outcome"),
        F.col("noised").alias("dp_values_noised"),
        F.col("ts").alias("created_at"),
    )


def respond(done: DataFrame, key: bytes = TEST_KEY, id_col: str = "session_id") -> DataFrame:
    """Guard and restore the model's ``output``: one row per clear prompt with an answer, with its warnings."""
    clear = done.where(~F.col("verdict.attack") & F.col("output").isNotNull())
    guarded = D.with_spans(clear.select(id_col, "output"), "output", lexicon=()).select(id_col, D.generated_types(F.col("spans")).alias("generated"))
    back = D.restore(clear, D.vault(clear, key=key), id_col)
    rows = clear.select(*{id_col: 0, "session_id": 0}, "outbound", "noised", "truncated", "budget_allowed", "issued").join(back, id_col).join(guarded, id_col)
    warnings = F.array_compact(F.array(
        F.when(F.col("truncated"), F.lit("capacity: some values were redacted irreversibly")),
        F.when(~F.col("budget_allowed"), F.lit("budget: numbers were sent without perturbation")),
        F.when(F.col("unknown_count") > 0, F.lit("unknown placeholders were left as they are")),
        F.when(F.size("generated") > 0, F.concat(F.lit("generated: "), F.array_join("generated", ","))),
    ))
    return rows.select(*{id_col: 0, "session_id": 0}, "outbound", "restored", "restored_count", "unknown_count", "noised", "issued", F.size("generated").alias("generated"), warnings.alias("warnings"))


def page(rows: DataFrame, number: int = 0, size: int = 50) -> DataFrame:
    """A page of the newest rows; sizes are held to 1 to 200. Ties fall to the greater id."""
    size = max(1, min(200, size))
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(max(0, number) * size).limit(size)


def retained(rows: DataFrame, now: F.Column, keep: str = "30 days") -> DataFrame:
    """Rows that retention keeps; on a table partitioned by day the filter also prunes partitions."""
    return rows.where(F.col("created_at") >= now - F.expr(f"interval {keep}"))


def redactions_by_type(done: DataFrame) -> DataFrame:
    return done.where(~F.col("verdict.attack")).transform(lambda d: exploded(d, F.col("spans.type"), name="type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def counters(done: DataFrame, responses: DataFrame) -> DataFrame:
    """The seven counters, one row: of processed prompts with their ``output``, and of the responses."""
    failed = F.col("output").isNull() & ~F.col("verdict.attack")
    sent = done.agg(F.count(F.lit(1)).alias("prompts"), F.count_if("verdict.attack").alias("attacks"), F.count_if(failed).alias("model_failures"), F.count_if(~F.col("budget_allowed")).alias("budget_exhausted"), F.count_if("truncated").alias("capacity_exceeded"))
    back = responses.agg(F.coalesce(F.sum("unknown_count"), F.lit(0)).alias("unknown_tokens"), F.count_if(F.col("generated") > 0).alias("generated_pii"))
    return sent.join(back)  # one row each


def latency(rows: DataFrame, label: str, value: F.Column) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("longest"))


def status(done: DataFrame, lexicon_size: int) -> DataFrame:
    return done.agg(F.count(F.lit(1)).alias("total"), F.count_if("verdict.attack").alias("attacks")).select("*", F.lit(len(R.RULES)).alias("pattern_rules"), F.lit(len(R.SCREENING)).alias("threat_rules"), F.lit(lexicon_size).alias("lexicon_size"))


def health(spark: SparkSession, model_loaded: bool, ner_loaded: bool) -> DataFrame:
    return spark.createDataFrame([(model_loaded, ner_loaded, len(R.RULES) > 0)], "classifier boolean, ner boolean, rules boolean")


def percentiles(rows: DataFrame, label: str, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(label, n, p50, p95, ...) of the rows whose value is known, by exact discrete percentiles."""
    columns = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}") for p in at]
    return rows.where(F.col(value).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *columns)
