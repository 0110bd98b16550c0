import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veilspark.config import Noise, Vault
from veilspark.functions import noise, screening
from veilspark.functions.crypto import TEST_KEY, hmac_hex, placeholder
from veilspark.functions.rules import PLACEHOLDER, SUITE, dihedral_table, position_table
from veilspark.functions.spans import SPAN, resolve
from veilspark.operators import detection as D


def found(spark, text):
    rows = D.findings(D.with_spans(spark.createDataFrame([(1, text)], "doc_id int, text string"))).collect()
    return {(r["type"], r["value"]) for r in rows}


VECTORS = [
    ("4539578763621486", "CARD", True), ("4111 1111 1111 1111", "CARD", True), ("Order 1234567890123456", "CARD", False),
    ("123-45-6789", "SSN", True), ("666-45-6789", "SSN", False), ("192.168.1.100", "IP", True), ("999.888.777.666", "IP", False),
    ("234567890124", "AADHAAR", True), ("234567890125", "AADHAAR", False), ("9876543210", "PHONE", True), ("0000000000", "PHONE", False),
    ("user@example.com", "EMAIL", True), ("31/12/1999", "DOB", True), ("AKIA" + "Q" * 16, "SECRET", True), ("xox" + "b-" + "a1" * 8, "SECRET", True),
    ("Priya Sharma", "NAME", True), ("priya sharma", "NAME", False), ("é4539578763621486", "CARD", True),
]


def test_vectors(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(VECTORS)], "doc_id int, text string")
    rows = D.findings(D.with_spans(df)).collect()
    for i, (text, kind, expected) in enumerate(VECTORS):
        assert (kind in {r["type"] for r in rows if r["doc_id"] == i}) is expected, text


def test_spans_slice_back(spark):
    text = "a@b.com, then +1 (555) 123-4567 for Maria Silva and 10.0.0.1"
    for r in D.findings(D.with_spans(spark.createDataFrame([(1, text)], "doc_id int, text string"))).collect():
        assert text[r["start"] : r["end"]] == r["value"]


@pytest.mark.parametrize(
    "spans, kept",
    [([(10, 26, 90), (10, 20, 50)], [(10, 26)]), ([(0, 10, 50), (5, 20, 100)], [(0, 10)]), ([(0, 5, 80), (0, 9, 80)], [(0, 9)]), ([(0, 5, 90), (5, 9, 50)], [(0, 5), (5, 9)]), ([], [])],
)
def test_resolution(spark, spans, kept):
    rows = [([(s, -p, s - e, i, e, "T", "v", "d") for i, (s, e, p) in enumerate(spans)],)]
    out = spark.createDataFrame(rows, f"spans array<{SPAN}>").select(resolve(F.col("spans")).alias("r")).first()["r"]
    assert [(x["start"], x["end"]) for x in out] == kept


def test_round_trip_and_isolation(spark):
    texts = ["mail a@b.com and a@b.com, card 4111 1111 1111 1111", "", None, "value $1 \\ x@y.org", "forged [EMAIL_ABCDEFGHIJ]"]
    df = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "doc_id int, session_id string, text string")
    done = D.redact(df).withColumnRenamed("redacted", "output").cache()
    vault = D.vault(done)
    back = {r["doc_id"]: r for r in D.restore(done, vault).collect()}
    clean = [(t or "").replace("[EMAIL_ABCDEFGHIJ]", "[REDACTED]") for t in texts]
    assert [back[i]["restored"] for i in range(5)] == clean
    first = done.where("doc_id = 0").first()["output"]
    assert "@" not in first and first.count("[EMAIL_") == 2 and len(set(__import__("re").findall(PLACEHOLDER, first))) == 2
    other = done.withColumn("session_id", F.lit("elsewhere"))
    assert D.unknown_tokens(other, vault).count() == 4


def test_capacity_keeps_the_last_values(spark):
    df = spark.createDataFrame([(1, "s", "a@x.org b@x.org c@x.org a@x.org")], "doc_id int, session_id string, text string")
    out = D.redact_with_capacity(df, cfg=Vault(max_values=2)).first()
    assert out["truncated"] and out["redacted"].count("[EMAIL_REDACTED]") == 1 and out["issued"] == 3


def test_hmac_matches_python(spark):
    df = spark.createDataFrame([("é😀",)], "t string").select(hmac_hex(F.encode("t", "UTF-8")).alias("h"))
    assert df.first()["h"] == hmac.new(TEST_KEY, "é😀".encode(), hashlib.sha256).hexdigest()


def test_placeholder_shape(spark):
    a, b = spark.createDataFrame([("s", "EMAIL", "x"), ("t", "EMAIL", "x")], "s string, t string, v string").select(placeholder(F.col("s"), F.col("t"), F.col("v")).alias("p")).collect()
    assert __import__("re").fullmatch(PLACEHOLDER, a["p"]) and a["p"] != b["p"]


def test_tables():
    d, p = dihedral_table(), position_table()
    assert all(sorted(d[i * 10 : i * 10 + 10]) == list(range(10)) for i in range(10)) and len(p) == 80
    assert d[5 * 10 + 1] == 9 and d[5 * 10 + 5] == 0


@pytest.mark.parametrize("text, n", [("Take 2 tablets for 10 days", 0), ("signed in 2019, renewed 2024", 0), ("Revenue was 4,500,000", 1), ("A 5000000 B 7000000 C 9000000", 3), ("v1.2.3 x1234", 0)])
def test_noise(spark, text, n):
    r = spark.createDataFrame([(1, text)], "i int, t string").select(noise.apply_noise(F.col("t"), F.col("i")).alias("n")).first()["n"]
    assert r["noised"] == n and r["epsilon"] == n * Noise().epsilon and (r["text"] == text) is (n == 0)


def test_noise_is_sane(spark):
    df = spark.range(500).select(noise.noisy(F.lit("10000000"), F.col("id").cast("string")).cast("double").alias("x"))
    values = [r["x"] for r in df.collect()]
    assert sum(abs(v - 1e7) > 1e7 for v in values) < 25 and len(set(values)) > 450


def test_suite(spark):
    df = spark.createDataFrame(SUITE, "c string, p string, b boolean").select("b", screening.first_rule(F.col("p")).isNotNull().alias("hit"))
    assert all(r["b"] == r["hit"] for r in df.collect())


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Noise(epsilon=0)
    with pytest.raises(ValueError):
        Vault(letters=4)


def test_numbers_of_documents(spark, tmp_path):
    """The number queries read every document, long and null ones too, besides the made texts and the orders."""
    from veilspark import registry
    from veilspark.sources.vectors import rows

    docs = [(1, "Revenue was 4,500,000 in 2019"), (2, None), (3, "word " * 20_000 + "98765 end 12"), (4, ""), (5, "v1.2.3 5000x 1234.5")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 7, 2500.5)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    found = [tuple(r) for r in registry.eligible_numbers(spark, str(tmp_path)).where("doc_id > 0").collect()]
    want = [(1, "4,500,000", True), (1, "2019", False), (3, "98765", True), (3, "12", False), (5, "1234.5", True), (1, "1", False), (1, "7", False), (1, "2500.50", True)]
    assert sorted(found) == sorted(want)
    noisy = registry.noisy_texts(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in noisy) == sorted([*(i for i, _ in docs), 1, *(i for i, _ in rows())])
    counts = {(r["doc_id"], (r["text"] or "")[:5] == "order"): r["noised"] for r in noisy if r["doc_id"] > 0}
    assert {k: n or 0 for k, n in counts.items()} == {(1, False): 1, (2, False): 0, (3, False): 1, (4, False): 0, (5, False): 1, (1, True): 1}


def test_regressions_converge(spark):
    """The tolerance ends every fold's fit, not the bound of rounds."""
    from veilspark.operators import classifier as C

    _, models = C.fit(C.training_rows(spark))
    rounds = [(m.summary.totalIterations, m.getMaxIter()) for m, _, _ in models]
    assert len(rounds) == C.FOLDS and all(n < most for n, most in rounds)


def test_literals_never_hide_a_match(spark):
    """With and without the literals that are looked for first, all rules find the same."""
    from veilspark.functions import rules as R
    from veilspark.functions.spans import match_spans
    from veilspark.functions.validators import CHECKS
    from veilspark.sources.vectors import rows

    texts = [t for _, t in rows()] + [p for _, p, _ in SUITE] + [p.upper() for _, p, _ in SUITE] + ["R  e v e a l", "xV\te a l", "ABCD:1:2:3:4:5:6:7 no digit: a:b:c:d:e:f:a:b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    text = F.col("t")
    spans = [match_spans(text, r.pattern, r.type, r.priority, k, "REGEX", CHECKS.get(r.check)) for k, r in enumerate(R.RULES)]
    from veilspark.functions.spans import rule_spans

    assert all(r["a"] == r["b"] for r in df.select(rule_spans(text).alias("a"), F.concat(*spans).alias("b")).collect())
    plain = [F.when(text.rlike("(?i)" + R.ascii_space(p).replace(r"\b", R.BORDER)), F.lit(n)) for n, p in R.SCREENING if n in R.SCREENING_HOLDS and p]
    found = df.select(screening.all_rules(text).alias("a"), F.array_compact(F.array(*plain)).alias("b")).collect()
    assert all([x for x in r["a"] if x not in ("OBFUSCATED_SPACED", "OBFUSCATED_LEET_DENSITY")] == r["b"] for r in found)
    assert "OBFUSCATED_SPACED" in found[-3]["a"]


def test_density_is_one_pattern(spark):
    import random
    import re

    from veilspark.functions import rules as R

    rnd = random.Random(4)
    words = ["".join(rnd.choice("ab0134_9 é") for _ in range(rnd.randint(3, 26))) for _ in range(3000)]
    twice, form = re.compile(R.LEET_TWICE), re.compile(R.LEET_FORM)
    want = [any(twice.search(w) and form.search(w) for w in re.findall(R.LEET_WORD, t, re.A)) for t in words]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(words)], "i int, t string").select("i", screening._hits(F.col("t"), "OBFUSCATED_LEET_DENSITY", "").alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == want and any(want)


def test_spans_are_computed_once(spark):
    """No filter that holds the rules again below the projection that makes the spans."""
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id int, text string")
    plan = D.findings(D.with_spans(df).withColumn("spans", resolve(F.col("spans"))))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "AKIA" in line]


def test_lexicon_drops_nothing(spark, tmp_path, monkeypatch):
    from veilspark.sources import tables

    (tmp_path / "words.txt").write_text("# names\nAnna\n\n Bo \nAnna\n")
    assert tables.lexicon(spark, str(tmp_path / "words.txt")) == ["Anna", "Bo"]
    monkeypatch.setattr(tables, "MAX_LEXICON", 1)
    with pytest.raises(ValueError):
        tables.lexicon(spark, str(tmp_path / "words.txt"))
