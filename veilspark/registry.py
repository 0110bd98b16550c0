"""All queries of the library proper and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Noise, RateLimit, Vault
from .functions import noise as N
from .functions import rules as R
from .functions import screening as S
from .functions.crypto import fingerprint, prompt_fingerprint
from .functions.spans import exploded, name_candidates, name_spans, resolve
from .functions.validators import is_aadhaar, is_card, is_ipv4, is_phone
from .operators import detection as D
from .operators import stateful as K
from .plans import audit as A
from .plans import oracle as O
from .sources.tables import LEXICON, rejection, spread, table
from .sources.vectors import rows

FLAGSHIP = "redact_documents"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundled documents and the hand-made texts."""
    made = spark.createDataFrame(rows(), "doc_id long, text string").coalesce(1)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).unionByName(made)


def _session(df: DataFrame) -> DataFrame:
    return df.withColumn("session_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))


_SESSION = "'doc-' || doc_id::VARCHAR"
_FOUND = f"WITH {O.TEXTS}, {O.CLEAN}, found AS ({O.findings()})"
_RES = f"{_FOUND}, {O.RESOLVED}"
_COLS = 'doc_id, start::INT AS start, "end"::INT AS "end", type, value, detector, priority, ord'


# ---- detection ----


@query(f"WITH {O.TEXTS}, found AS ({O.findings('texts')}) SELECT {_COLS} FROM found")
def detect_findings(spark, sf_dir):
    return D.findings(D.with_spans(texts(spark, sf_dir)))


@query(f"WITH {O.TEXTS}, found AS ({O.rule_findings('texts')}) SELECT ord, type, count(*) AS n, count(DISTINCT doc_id) AS texts FROM found GROUP BY ALL")
def rule_counts(spark, sf_dir):
    found = D.findings(D.with_spans(texts(spark, sf_dir), lexicon=()))
    return found.groupBy("ord", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("texts"))


@query(f"WITH {O.TEXTS}, found AS ({O.findings('texts')}), {O.RESOLVED} SELECT {_COLS} FROM resolved")
def resolve_overlaps(spark, sf_dir):
    return D.findings(D.with_spans(texts(spark, sf_dir)).withColumn("spans", resolve(F.col("spans"))))


@query(f"""WITH {O.TEXTS}, found AS ({O.findings('texts')}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, start) AS i FROM found)
SELECT a.doc_id, a.start::INT AS start_a, a."end"::INT AS end_a, a.type AS type_a, b.start::INT AS start_b, b."end"::INT AS end_b, b.type AS type_b
FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.i < b.i AND a.start < b."end" AND b.start < a."end" """)
def contested_spans(spark, sf_dir):
    return D.contested(D.with_spans(texts(spark, sf_dir)))


@query(f"WITH {O.TEXTS}, found AS ({O.findings('texts')}), {O.RESOLVED} SELECT type, count(*) AS n FROM resolved GROUP BY type")
def detect_counts_by_type(spark, sf_dir):
    found = D.with_spans(texts(spark, sf_dir)).withColumn("spans", resolve(F.col("spans")))
    return exploded(found, F.col("spans.type"), name="type").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH texts AS (SELECT doc_id, text FROM documents), found AS ({O.rule_findings('texts')} UNION ALL BY NAME {O.name_runs('texts')}), {O.RESOLVED}
SELECT lang, source, type, count(*) AS n FROM resolved JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source, type)""")
def detect_counts_by_lang_source(spark, sf_dir):
    docs = D.with_spans(spread(table(spark, sf_dir, "documents"))).withColumn("spans", resolve(F.col("spans")))
    return exploded(docs, F.col("spans.type"), "lang", "source", name="type").rollup("lang", "source", "type").agg(F.count(F.lit(1)).alias("n"))


_CANDIDATES = "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9](?:[0-9 .-]{5,22})[0-9]')) AS value FROM texts"


def _candidates(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit("[0-9](?:[0-9 .-]{5,22})[0-9]"), F.lit(0))).alias("value"))


@query(f"WITH {O.TEXTS} SELECT doc_id, value, {O._LUHN} AS card, {O._VERHOEFF} AS aadhaar, {O._PHONE} AS phone, CASE WHEN regexp_full_match(value, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') THEN {O._IPV4} END AS ipv4 FROM ({_CANDIDATES})")
def validators(spark, sf_dir):
    v = F.col("value")
    shape = v.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$")
    return _candidates(spark, sf_dir).select("doc_id", "value", is_card(v).alias("card"), is_aadhaar(v).alias("aadhaar"), is_phone(v).alias("phone"), F.when(shape, is_ipv4(v)).alias("ipv4"))


@query(f"WITH {O.TEXTS} SELECT doc_id, start::INT AS start, \"end\"::INT AS \"end\", value FROM ({O.spans('texts', O.NAME_RE2, '1 AS x')})")
def name_candidate_words(spark, sf_dir):
    return D.findings(texts(spark, sf_dir).withColumn("spans", name_candidates(F.col("text")))).select("doc_id", "start", "end", "value")


@query(f"WITH {O.TEXTS} SELECT value, count(*) AS n FROM ({O.name_tokens('texts')}) WHERE is_name GROUP BY value")
def lexicon_hits(spark, sf_dir):
    words = D.findings(texts(spark, sf_dir).withColumn("spans", name_candidates(F.col("text"))))
    listed = spark.createDataFrame([(w,) for w in LEXICON], "value string")
    return words.join(F.broadcast(listed), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.TEXTS} SELECT doc_id, start::INT AS start, \"end\"::INT AS \"end\", value FROM ({O.name_runs('texts')})")
def name_runs(spark, sf_dir):
    return D.findings(texts(spark, sf_dir).withColumn("spans", name_spans(F.col("text"), list(LEXICON)))).select("doc_id", "start", "end", "value")


# ---- redaction and restoration ----


@query(f"WITH {O.TEXTS}, {O.CLEAN} SELECT doc_id, text AS clean FROM clean")
def neutralise_tokens(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", D.neutralise(F.coalesce("text", F.lit(""))).alias("clean"))


_MARKS = f"marks AS (SELECT *, {O.token(_SESSION)} AS token FROM resolved)"


@query(f"{_RES}, {_MARKS}, red AS ({O.rebuilt('clean', 'marks')}) SELECT doc_id, redacted, coalesce(n, 0)::INT AS issued FROM red LEFT JOIN (SELECT doc_id, count(*) AS n FROM marks GROUP BY doc_id) USING (doc_id)")
def redact_documents(spark, sf_dir):
    return D.redact(_session(texts(spark, sf_dir))).select("doc_id", "redacted", "issued")


@query(f"{_RES}, {_MARKS} SELECT DISTINCT {_SESSION} AS session_id, type, value, token FROM marks")
def vault_entries(spark, sf_dir):
    return D.vault(D.redact(_session(texts(spark, sf_dir))))


@query(f"{_RES} SELECT type, value, sha256(encode(type) || unhex('00') || encode(value)) AS fingerprint, count(*) AS mentions FROM resolved GROUP BY ALL")
def token_fingerprints(spark, sf_dir):
    found = D.findings(D.redact(_session(texts(spark, sf_dir))))
    return found.groupBy("type", "value").agg(F.count(F.lit(1)).alias("mentions")).withColumn("fingerprint", fingerprint(F.col("type"), F.col("value")))


_LANG = "(SELECT d.doc_id, coalesce(lang, 'made') AS lang FROM texts d LEFT JOIN documents USING (doc_id))"


def _by_lang(spark, sf_dir):
    docs = texts(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "left")
    return docs.select("doc_id", "text", F.coalesce("lang", F.lit("made")).alias("session_id"))


@query(f"""{_RES}, r AS (SELECT * FROM resolved JOIN {_LANG} l USING (doc_id)),
ranked AS (SELECT lang, type, value, row_number() OVER (PARTITION BY lang ORDER BY max(doc_id * 1000000 + start) DESC) AS k FROM r GROUP BY lang, type, value),
marks AS (SELECT r.*, CASE WHEN k > 5 THEN '[' || type || '_REDACTED]' ELSE {O.token('lang')} END AS token, k FROM r JOIN ranked USING (lang, type, value)),
red AS ({O.rebuilt('clean', 'marks')})
SELECT doc_id, redacted, coalesce(n, 0)::INT AS issued, coalesce(t, false) AS truncated FROM red LEFT JOIN (SELECT doc_id, count(*) FILTER (k <= 5) AS n, bool_or(k > 5) AS t FROM marks GROUP BY doc_id) USING (doc_id)""")
def vault_capacity(spark, sf_dir):
    return D.redact_with_capacity(_by_lang(spark, sf_dir), cfg=Vault(max_values=5)).select("doc_id", "redacted", "issued", "truncated")


@query(f"WITH {O.TEXTS}, {O.CLEAN} SELECT doc_id, text AS restored FROM clean")
def restore_roundtrip(spark, sf_dir):
    """Restoring a redacted text gives the neutralised input back."""
    done = D.redact(_session(texts(spark, sf_dir))).withColumnRenamed("redacted", "output")
    return D.restore(done, D.vault(done)).select("doc_id", "restored")


def _echo(spark, sf_dir):
    """Every redacted text answered within the session of the document before it: its placeholders are not known there."""
    done = D.redact(_session(texts(spark, sf_dir))).withColumnRenamed("redacted", "output")
    mixed = done.where(F.size("spans") > 0).withColumn("session_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("session_id")).otherwise(F.lit("other")))
    return done, mixed


@query(f"{_RES}, {_MARKS} SELECT doc_id, 'other' AS session_id, token, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS pos FROM marks WHERE abs(doc_id) % 2 = 1")
def unknown_tokens(spark, sf_dir):
    done, mixed = _echo(spark, sf_dir)
    return D.unknown_tokens(mixed, D.vault(done))


@query(f"WITH {O.TEXTS}, found AS ({O.rule_findings('texts')}) SELECT doc_id, string_agg(type, ',' ORDER BY o) AS types FROM (SELECT doc_id, type, min(ord) AS o FROM found GROUP BY ALL) GROUP BY doc_id")
def generated_types(spark, sf_dir):
    found = D.with_spans(texts(spark, sf_dir), lexicon=()).where(F.size("spans") > 0)
    return found.select("doc_id", F.array_join(D.generated_types(F.col("spans")), ",").alias("types"))


@query(f"{_RES}, dim AS (SELECT * FROM {O.values(R.ENTITY_TYPES, 'type, severity')}) SELECT doc_id, coalesce(max(severity), 0) AS severity FROM texts LEFT JOIN resolved USING (doc_id) LEFT JOIN dim USING (type) GROUP BY doc_id")
def severity_report(spark, sf_dir):
    return D.redact(_session(texts(spark, sf_dir))).select("doc_id", D.highest_severity(F.col("spans.type")).alias("severity"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' ELSE 'too long' END AS reason FROM documents WHERE text IS NULL OR trim(text) = '' OR length(text) > 10000")
def validation_rejects(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rejection(F.col("text")).alias("reason")).where("reason is not null")


# ---- numbers and budget ----

_NUMBER_RE2 = r"(?:^|[^A-Za-z0-9_.])(-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|-?[0-9]+(?:\.[0-9]+)?)\b"


@query(f"""WITH {O.TEXTS}, o AS (SELECT doc_id, text FROM texts UNION ALL SELECT o_orderkey, 'order ' || o_orderkey || ' of ' || o_custkey || ' total ' || printf('%.2f', o_totalprice) FROM orders),
n AS (SELECT doc_id, unnest(regexp_extract_all(text, {O.q(_NUMBER_RE2)}, 1)) AS literal FROM o)
SELECT doc_id, literal, abs(replace(literal, ',', '')::DOUBLE) >= 1000 AND NOT (length(literal) = 4 AND NOT regexp_matches(literal, '[.,]') AND replace(literal, ',', '')::DOUBLE BETWEEN 1900 AND 2100) AS eligible FROM n""")
def eligible_numbers(spark, sf_dir):
    found = _numbered(spark, sf_dir).select("doc_id", F.explode(N.numbers(F.col("text"))).alias("s"))
    return found.select("doc_id", F.col("s.value").alias("literal"), N.is_eligible(F.col("s.value")).alias("eligible"))


def _numbered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.format_string("order %d of %d total %.2f", "o_orderkey", "o_custkey", "o_totalprice").alias("text"))
    return texts(spark, sf_dir).unionByName(orders)


_U = f"((('0x' || substr({O.hmac('encode(o_orderkey::VARCHAR)')}, 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 - 0.5"


@query(f"WITH u AS (SELECT o_orderkey, floor(o_totalprice) AS v, {_U} AS u FROM orders), x AS (SELECT o_orderkey, v, v - greatest(1.0, abs(v) * 0.02) / 0.5 * sign(u) * ln(1.0 - 2.0 * abs(u)) AS x FROM u) SELECT o_orderkey, CASE WHEN abs(v) >= 1000 AND NOT (v BETWEEN 1900 AND 2100) THEN floor(x + 0.5)::BIGINT::VARCHAR ELSE v::BIGINT::VARCHAR END AS noisy FROM x")
def noisy_numbers(spark, sf_dir):
    lit = F.floor("o_totalprice").cast("string")
    rows_ = table(spark, sf_dir, "orders").select("o_orderkey", lit.alias("literal"))
    value = F.when(N.is_eligible(F.col("literal")), N.noisy(F.col("literal"), F.col("o_orderkey").cast("string"))).otherwise(F.col("literal"))
    return rows_.select("o_orderkey", value.alias("noisy"))


@query()
def noisy_texts(spark, sf_dir):
    """Texts with every eligible number replaced: rows only, since decimals are rounded by each engine's own rules."""
    done = _numbered(spark, sf_dir).withColumn("n", N.apply_noise(F.col("text"), F.col("doc_id")))
    return done.select("doc_id", F.col("n.text").alias("text"), F.col("n.noised").alias("noised"), F.col("n.epsilon").alias("epsilon"))


_EVENT_COST = "(CASE WHEN abs(value) >= 1 THEN 0.5 ELSE 0.0 END)"


def _costs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.abs("value") >= 1, 0.5).otherwise(0.0).alias("cost"))


@query(f"SELECT user_id, sum({_EVENT_COST}) AS epsilon, count(*) AS requests FROM events GROUP BY user_id")
def epsilon_by_subject(spark, sf_dir):
    return _costs(spark, sf_dir).groupBy("user_id").agg(F.sum("cost").alias("epsilon"), F.count(F.lit(1)).alias("requests"))


@query(f"""WITH c AS (SELECT event_id, user_id, ts, {_EVENT_COST} AS cost FROM events),
g AS (SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) >= 1000 * 3600 THEN 1 ELSE 0 END AS n FROM c),
e AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM g),
b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY user_id, ep ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT event_id, user_id, ep::BIGINT AS epoch, 1.5 - before > 0 AS allowed, CASE WHEN 1.5 - before > 0 THEN cost ELSE 0.0 END AS charged FROM b""")
def budget_decisions(spark, sf_dir):
    done = K.budget_decisions(_costs(spark, sf_dir), "user_id", "ts", "event_id", "cost", Noise(budget=1.5, idle_reset_hours=1000))
    return done.select("event_id", "user_id", "epoch", "allowed", "charged")


# ---- screening ----


def _screened(spark, sf_dir):
    suite = spark.createDataFrame([(-1000 - i, p) for i, (_, p, _) in enumerate(R.SUITE)], "doc_id long, text string")
    talks = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("doc_id"), "text")
    return texts(spark, sf_dir).unionByName(suite).unionByName(talks)


_SCREENED = f"WITH {O.TEXTS}, s AS (SELECT * FROM texts UNION ALL SELECT * FROM {O.values([(-1000 - i, p) for i, (_, p, _) in enumerate(R.SUITE)], 'doc_id, text')} UNION ALL SELECT conv_id * 1000 + turn + 1000000000, text FROM conversations)"


@query(f"{_SCREENED} SELECT doc_id, {O.first_rule()} AS rule FROM s")
def threat_rule(spark, sf_dir):
    return _screened(spark, sf_dir).select("doc_id", S.first_rule(F.col("text")).alias("rule"))


@query(f"{_SCREENED}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, {O.q(n)} AS rule FROM s WHERE {h}" for n, h in O.screening_hits()) + ") SELECT rule, count(*) AS n FROM h GROUP BY rule")
def threat_all_hits(spark, sf_dir):
    return _screened(spark, sf_dir).select(F.explode(S.all_rules(F.col("text"))).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def suite(spark):
    """The labelled suite with the rule layer's verdicts and a status each."""
    cases = spark.createDataFrame(R.SUITE, "category string, payload string, should_block boolean")
    v = S.verdict(S.first_rule(F.col("payload")), F.lit(None).cast("string"), F.lit(None).cast("double"))
    done = cases.withColumn("v", v).select("*", F.col("v.attack").alias("blocked"), F.col("v.rule").alias("rule")).drop("v")
    status = F.when(F.col("should_block") & F.col("blocked"), "BLOCKED").when(F.col("should_block"), "MISSED").when(F.col("blocked"), "FALSE POSITIVE").otherwise("ALLOWED")
    return done.withColumn("passed", F.col("blocked") == F.col("should_block")).withColumn("status", status)


_SUITE = f"WITH c AS (SELECT * FROM {O.values(R.SUITE, 'category, payload, should_block')}), r AS (SELECT *, {O.first_rule('payload')} AS r FROM c), v AS (SELECT category, payload, should_block, r IS NOT NULL AS blocked, coalesce(r, 'none') AS rule, (r IS NOT NULL) = should_block AS passed, CASE WHEN should_block AND r IS NOT NULL THEN 'BLOCKED' WHEN should_block THEN 'MISSED' WHEN r IS NOT NULL THEN 'FALSE POSITIVE' ELSE 'ALLOWED' END AS status FROM r)"


@query(f"{_SUITE} SELECT * FROM v")
def suite_results(spark, sf_dir):
    return suite(spark)


@query(f"{_SUITE} SELECT category, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM v GROUP BY ROLLUP (category)")
def suite_summary(spark, sf_dir):
    return suite(spark).rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


_FUSION = [(r, lab, c) for r in ("RULE", None) for lab, c in (("ATTACK", 0.9), ("ATTACK", 0.75), ("ATTACK", 0.5), ("SAFE", 0.99), (None, None))]


@query(f"""WITH p AS (SELECT rule, label, confidence::DOUBLE AS confidence, closed FROM {O.values(_FUSION, 'rule, label, confidence')}, (VALUES (true), (false)) x(closed)), m AS (SELECT *, coalesce(label = 'ATTACK' AND confidence >= 0.75, false) AS ml FROM p)
SELECT coalesce(rule, '-') AS in_rule, coalesce(label, '-') AS in_label, confidence AS in_confidence, closed, ml OR rule IS NOT NULL OR (label IS NULL AND closed) AS attack,
CASE WHEN ml AND rule IS NOT NULL THEN 'ML+REGEX' WHEN ml THEN 'ML' WHEN rule IS NOT NULL THEN 'REGEX' WHEN label IS NULL AND closed THEN 'UNAVAILABLE' ELSE 'NONE' END AS method,
CASE WHEN ml THEN confidence ELSE 0.0 END AS confidence,
CASE WHEN ml AND rule IS NULL THEN 'ml-classifier' WHEN rule IS NOT NULL THEN rule WHEN label IS NULL AND closed THEN 'ml-unavailable-fail-closed' ELSE 'none' END AS rule FROM m""")
def verdict_fusion(spark, sf_dir):
    cases = spark.createDataFrame(_FUSION, "rule string, label string, confidence double")
    both = [cases.withColumn("closed", F.lit(c)).withColumn("v", S.verdict(F.col("rule"), F.col("label"), F.col("confidence"), fail_closed=c)) for c in (True, False)]
    return both[0].unionByName(both[1]).select(F.coalesce("rule", F.lit("-")).alias("in_rule"), F.coalesce("label", F.lit("-")).alias("in_label"), F.col("confidence").alias("in_confidence"), "closed", "v.attack", "v.method", "v.confidence", "v.rule")


# ---- admission, sessions ----

_BUCKET = RateLimit(capacity=2.0, per_minute=1 / 720)


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
b AS (SELECT user_id, event_id, ts, us, k, 60000000::BIGINT AS level, true AS admitted FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.event_id, o.ts, o.us, o.k, l - CASE WHEN l >= 60000000 THEN 60000000 ELSE 0 END, l >= 60000000
FROM b JOIN o ON o.user_id = b.user_id AND o.k = b.k + 1, LATERAL (SELECT least(120000000, b.level + trunc((o.us - b.us) * (1.0::DOUBLE / 720))::BIGINT) AS l))
SELECT user_id AS client, event_id, ts, admitted FROM b""")
def rate_limit_bucket(spark, sf_dir):
    return K.token_bucket(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", _BUCKET)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS expires, count(*) AS requests FROM s GROUP BY user_id, k""")
def vault_sessions(spark, sf_dir):
    return K.sessions(table(spark, sf_dir, "events"), "user_id", "ts", Vault(ttl_minutes=720))


@query("""WITH RECURSIVE o AS (SELECT event_type, event_id, floor(epoch_us(ts) / 1000000)::BIGINT AS s, event_id % 3 <> 0 AS failed, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch_us(ts) / 1000000), event_id) AS k FROM events),
b AS (SELECT event_type, event_id, k, 0::BIGINT AS fails, 0::BIGINT AS since, true AS called FROM (SELECT DISTINCT event_type, NULL::BIGINT AS event_id, 0::BIGINT AS k FROM events)
UNION ALL SELECT o.event_type, o.event_id, o.k, CASE WHEN NOT c.called THEN b.fails WHEN o.failed THEN b.fails + 1 ELSE 0 END, CASE WHEN c.called AND o.failed THEN o.s ELSE b.since END, c.called
FROM b JOIN o ON o.event_type = b.event_type AND o.k = b.k + 1, LATERAL (SELECT b.fails < 3 OR o.s - b.since >= 30 AS called) c)
SELECT event_type AS "key", event_id, called, fails >= 3 AS open FROM b WHERE k > 0""")
def breaker_states(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("failed", F.pmod("event_id", F.lit(3)) != 0)
    return K.breaker_states(events, "event_type", "ts", "event_id", "failed")


# ---- audit and metrics ----


@query(f"""{_RES}, n AS (SELECT doc_id, type, count(*) AS c FROM resolved GROUP BY ALL), dim AS (SELECT * FROM {O.values([(t, i) for i, (t, _) in enumerate(R.ENTITY_TYPES)], 'type, o')}),
s AS (SELECT doc_id, string_agg(type || '=' || c, ', ' ORDER BY o) AS s FROM n JOIN dim USING (type) GROUP BY doc_id),
v AS (SELECT doc_id, text, {O.first_rule("coalesce(text, '')")} AS rule FROM texts)
SELECT 'doc-' || doc_id AS session_id, CASE WHEN text IS NULL THEN '' ELSE {O.hmac('encode(text)')} END AS prompt_fingerprint, coalesce(length(text), 0)::INT AS prompt_length,
CASE WHEN rule IS NULL THEN coalesce(s, 'none') END AS pii_summary, rule IS NOT NULL AS attack_detected, CASE WHEN rule IS NULL THEN 'NONE' ELSE 'REGEX' END AS detection_method, coalesce(rule, 'none') AS detection_rule, CASE WHEN rule IS NULL THEN 'OK' ELSE 'BLOCKED' END AS outcome
FROM v LEFT JOIN s USING (doc_id)""")
def audit_rows(spark, sf_dir):
    cols = ["session_id", "prompt_fingerprint", "prompt_length", "pii_summary", "attack_detected", "detection_method", "detection_rule", "outcome"]
    return A.audit(A.process(_prompts(spark, sf_dir))).select(*cols)


def _prompts(spark, sf_dir):
    """Every text as a prompt of a session of its own; the subject and time follow from its id."""
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60)
    return _session(texts(spark, sf_dir)).select("session_id", F.concat(F.lit("s"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("subject"), ts.alias("ts"), "text", F.lit(True).alias("apply_noise"))


_TALK = "SELECT conv_id * 1000 + turn AS id, conv_id, turn, text, role, to_timestamp(1700000000 + conv_id * 60 + turn)::TIMESTAMP AS created_at FROM conversations"


def _talk(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text", "role", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn")).alias("created_at"))


@query(f"SELECT id, created_at FROM ({_TALK}) ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def audit_page(spark, sf_dir):
    return A.page(_talk(spark, sf_dir), 2, 50).select("id", "created_at")


@query(f"SELECT id, created_at FROM ({_TALK}) WHERE role = 'assistant' ORDER BY created_at DESC, id DESC LIMIT 200")
def audit_attacks(spark, sf_dir):
    """The filtered page, with a size beyond the limit of 200."""
    return A.page(_talk(spark, sf_dir).where("role = 'assistant'"), 0, 1000).select("id", "created_at")


@query(f"WITH t AS ({_TALK}) SELECT id, created_at FROM t WHERE created_at >= (SELECT max(created_at) FROM t) - INTERVAL 1 HOUR")
def audit_retention(spark, sf_dir):
    rows_ = _talk(spark, sf_dir)
    now = rows_.agg(F.max("created_at")).first()[0]
    return A.retained(rows_, F.lit(now), "1 hour").select("id", "created_at")


@query(f"SELECT {O.hmac('encode(text)')} AS fingerprint, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def fingerprint_repeats(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("text")).select(prompt_fingerprint(F.col("text")).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"{_RES}, v AS (SELECT doc_id FROM texts WHERE {O.first_rule('text')} IS NULL) SELECT type, count(*) AS n FROM resolved JOIN v USING (doc_id) GROUP BY type")
def metrics_by_type(spark, sf_dir):
    return A.redactions_by_type(A.process(_prompts(spark, sf_dir)))


@query(f"WITH {O.TEXTS} SELECT CASE WHEN {O.first_rule('text')} IS NULL THEN 'NONE' ELSE 'REGEX' END AS method, count(*) AS n FROM texts GROUP BY 1")
def metrics_by_method(spark, sf_dir):
    return A.process(_prompts(spark, sf_dir)).groupBy(F.col("verdict.method").alias("method")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, round(sum(abs(value)), 4) AS total, max(abs(value)) AS longest FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return A.latency(table(spark, sf_dir, "events").where("value is not null"), "event_type", F.abs("value")).withColumn("purchases", F.when(F.col("event_type") == "purchase", F.col("n")).otherwise(F.lit(0)))


@query("SELECT event_type, count(*) AS n, quantile_disc(abs(value), 0.5) AS p50, quantile_disc(abs(value), 0.95) AS p95, quantile_disc(abs(value), 0.99) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return A.percentiles(table(spark, sf_dir, "events").select("event_type", F.abs("value").alias("value")), "event_type", "value")


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), e AS (SELECT user_id, max(ts) + INTERVAL 12 HOUR AS expires FROM s GROUP BY user_id, k)
SELECT count(*) AS active FROM e WHERE expires > (SELECT max(ts) FROM events)""")
def active_sessions(spark, sf_dir):
    """Vault sessions that are open at the time of the last event."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    return K.sessions(events, "user_id", "ts", Vault(ttl_minutes=720)).join(F.broadcast(now)).where("expires > now").agg(F.count(F.lit(1)).alias("active"))


_FORWARDED = [(" 1.2.3.4 , 5.6.7.8", "r1"), (None, "r2"), ("x" * 46, "r3"), ("x" * 45, "r4"), ("", "r5"), (" , 9.9.9.9", "r6"), ("10.0.0.1", None)]


@query(f"""WITH f AS (SELECT forwarded, remote, trim(split_part(forwarded, ',', 1)) AS hop FROM {O.values(_FORWARDED, 'forwarded, remote')})
SELECT remote, CASE WHEN length(hop) BETWEEN 1 AND 45 THEN hop ELSE remote END AS client, CASE WHEN length(hop) > 0 THEN hop ELSE remote END AS subject FROM f""")
def client_keys(spark, sf_dir):
    """The keys of admission and of the budget from forwarded and remote addresses."""
    rows_ = spark.createDataFrame(_FORWARDED, "forwarded string, remote string")
    return rows_.select("remote", K.client_key(F.col("forwarded"), F.col("remote")).alias("client"), K.budget_subject(F.col("forwarded"), F.col("remote")).alias("subject"))


@query("SELECT false AS classifier, false AS ner, true AS rules")
def health_snapshot(spark, sf_dir):
    return A.health(spark, False, False)


@query()
def flow_counters(spark, sf_dir):
    """The seven counters of the whole flow, the model echoing what it is sent."""
    done = A.process(_prompts(spark, sf_dir)).withColumn("output", F.col("outbound"))
    return A.counters(done, A.respond(done))


@query(f"WITH {O.TEXTS}, v AS (SELECT {O.first_rule('text')} AS r FROM texts) SELECT count(*) AS total, count(*) FILTER (r IS NOT NULL) AS attacks, {len(R.RULES)} AS pattern_rules, {len(R.SCREENING)} AS threat_rules, {len(LEXICON)} AS lexicon_size FROM v")
def status_snapshot(spark, sf_dir):
    return A.status(A.process(_prompts(spark, sf_dir)), len(LEXICON))


@query()
def pipeline_responses(spark, sf_dir):
    """The whole flow, the model echoing what it is sent: responses with warnings and counts."""
    done = A.process(_prompts(spark, sf_dir))
    return A.respond(done.withColumn("output", F.col("outbound")))


@query()
def ml_predictions(spark, sf_dir):
    from .operators.classifier import evaluate

    return evaluate(spark)


