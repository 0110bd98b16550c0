"""Brute force and edge cases for the training-data operators, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import common
from veilspark.llm.common import LOCAL_SCRATCH, python_operators, scratch_dir

WS = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, h string"


@pytest.fixture(autouse=True)
def scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda _: str(tmp_path))
    python_operators(spark)


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a", "b", None])[i % len(sources or "abc")], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(n // 3)]
    out = [None, "", "   ", "one", "one", "é \U0001f600 end", "x" * 5000]
    for b in base:
        w = b.split(" ")
        out += [b, b.replace(" ", "\n", 1), " ".join(w[:-1] + ["changed"]), " ".join(w + base[0].split(" ")[:60])]
    return out


def test_exact_dedup(spark):
    from veilspark.llm.exact_dedup import drop_copies, exact_dedup

    texts = corpus()
    norm = [WS.sub(" ", t or "") for t in texts]
    for r in exact_dedup(table(spark, texts), salts=3).collect():
        same = [i for i, t in enumerate(norm) if t == norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (same[0], len(same), same[0] == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()
    kept = drop_copies(table(spark, texts))
    assert kept.count() == len(set(norm)) and kept.columns == table(spark, []).columns
    assert exact_dedup(table(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup(odd).collect()} == {(None, 3, 4), (3, 3, 4)}


def test_mixing(spark):
    from veilspark.llm.mixing import mix_sources, mixture

    texts = corpus(1, 240)
    rows = mix_sources(table(spark, texts)).collect()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total and len(rows) == len(texts)
    for s, t in targets.items():
        taken = sum(r["taken"] for r in rows if r["source"] == s)
        assert abs(taken - t) <= 2 * max(r["size"] for r in rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sum(r["taken"] for r in rows) <= 1.5 * total
    again = {(r["doc_id"], r["taken"]) for r in mix_sources(table(spark, texts).repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixture(table(spark, texts)).count() == sum(r["servings"] for r in rows)
    assert mix_sources(table(spark, [])).count() == 0 and {r["taken"] for r in mix_sources(table(spark, [None, ""])).collect()} == {0}


def test_suffix_dedup(spark):
    from veilspark.llm.suffix_dedup import remove_repeats

    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(180))
    texts = [None, "", "short", passage, "z" * 250, passage, "q" + passage[20:170] + "r"] + ["".join(rnd.choice("ab") for _ in range(rnd.randint(90, 130))) + passage[: rnd.randint(90, 180)] for _ in range(12)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    for shard in (300, 1 << 16):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(table(spark, texts), shard=shard).collect()}
        assert got == want
    assert remove_repeats(table(spark, [])).count() == 0


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    from veilspark.llm.suffix_dedup import remove_repeats

    rnd = random.Random(6)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p, q = make(180), make(260)
    rows = [(1, p), (1, p), (1, make(150) + q[:130]), (2, make(120)), (2, make(140)), (3, q), (3, q), (3, make(20) + q[60:200] + "!")]
    rows += [(None, t) for t in (make(200), make(220), p + make(110), q[30:190], q[30:190], None, "", "z" * 250, "z" * 250)] + [(9, "y" * 250)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, digest[r[1]])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        want[i, t] = (-1 if i is None else i, len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    for parts in (1, 5):
        got = remove_repeats(docs.repartition(parts), shard=300).collect()
        out = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got)
        assert out == sorted(want[r] for r in rows)


def test_repeated_windows_against_brute_force():
    from veilspark.llm.suffix_dedup import repeated_windows

    rnd = random.Random(1)
    for _ in range(150):
        length, n = rnd.choice([2, 4, 8]), rnd.randint(1, 12)
        alphabet = rnd.choice([b"ab", bytes([0, 255]), b"abc"])
        segments = [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(n)]
        docs, begins = np.arange(n)[::-1].copy(), np.array([rnd.randint(0, 5) for _ in range(n)])
        windows = [(s[o : o + length], (int(d), int(b) + o)) for s, d, b in zip(segments, docs, begins) for o in range(len(s) - length + 1)]
        first = {}
        for w, k in windows:
            first[w] = min(first.get(w, k), k)
        d, s = repeated_windows(segments, docs, begins, length, rnd.choice([8, 20, 1000]))
        assert set(zip(d.tolist(), s.tolist())) == {k for w, k in windows if first[w] != k}


@pytest.mark.parametrize("rounds", [1, 3])
def test_ngram_join(spark, monkeypatch, rounds):
    import veilspark.llm.ngram_join as J

    monkeypatch.setattr(J, "ROUNDS", rounds)
    if rounds == 1:  # many tiles, small stars, shuffled lookup
        monkeypatch.setattr(J, "TILE_ROWS", 2)
        monkeypatch.setattr(J, "TILE_COLUMNS", 3)
        monkeypatch.setattr(J, "STAR", 2)
        monkeypatch.setattr(J, "LOOKUP_ROWS", 0)
    texts = corpus(2, 90)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.ngram_components(table(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    if rounds == 3:
        assert J.ngram_components(table(spark, [])).count() == 0


def test_bpe_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from veilspark.llm.bpe import bpe_decode, bpe_encode, codec

    path = public_tokenizers.path("byte_bpe_50k.json")
    hard = [None, "", "  a   b\n\n c  ", "<|endoftext|> x<|endoftext|>", "a \n b", "it's 'S we'RE", "日本語 \U0001f600", "x" * 3000, "\x00\x7f", "a   b", "end "] + corpus(3)
    library = Tokenizer.from_file(path)
    rows = bpe_decode(bpe_encode(table(spark, hard), path), path).collect()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    offsets, ids = codec(path).encode_batch(pa.array([], pa.string()))
    assert len(ids) == 0 and offsets.tolist() == [0]
    clash = table(spark, hard).withColumnsRenamed({"h": "IDS", "bucket": "decoded"})
    both = {r["doc_id"]: r for r in bpe_encode(clash, path, decoded_col="decoded", drop=["text"]).collect()}
    assert [c for c in both[0].asDict()] == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]
    assert all(both[r["doc_id"]]["ids"] == r["ids"] and both[r["doc_id"]]["decoded"] == r["decoded"] for r in rows)
    assert bpe_decode(bpe_encode(table(spark, []), path), path).count() == 0


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from veilspark.llm.token_files import Image, pack_image, read_token_files, write_token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", "I'll it's don't.", "A \n B, É ΣΣ", "<|endoftext|>x", "́x", "\x1cb\x85d"] + corpus(4)
    write_token_files(table(spark, texts), str(tmp_path / "t"), path, 1, block=64, image_ids=500)
    got = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in read_token_files(spark, str(tmp_path / "t")).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert got[i] == (start, ids) and zlib.crc32(got[i][1]) == zlib.crc32(ids)
        start += len(ids) // 4
    values = np.random.default_rng(0).integers(0, 1 << 17, 1000).astype(np.uint32)
    image = Image(pack_image(np.array([7]), np.array([1000]), values, 17, block=96))
    assert (image.ids(100, 777) == values[100:777]).all()
    with pytest.raises(ValueError):
        pack_image(np.array([7]), np.array([1]), np.array([9], np.uint32), 3)


def test_fingerprints(spark):
    from veilspark.llm import fingerprint as P

    texts = corpus(6)
    rows = {r["doc_id"]: r for r in P.neighbour_fingerprints(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""  # descending ids; after the least comes the greatest
        n = len(t)
        edited = t[: n - n // 2] + following[: n // 2]
        r = rows[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sketch = lambda x: P.retain(P.shingle_hashes(P.code_points(x)))
        assert r["fingerprint"] == P.to_text(sketch(t)) and r["edited_fingerprint"] == P.to_text(sketch(edited))
        assert abs(r["near_edited"] - P.containment(sketch(t), sketch(edited))) < 1e-12
    a, b = P.shingle_hashes(P.code_points("a" * 30 + texts[-1])), P.shingle_hashes(P.code_points(texts[-2]))
    assert (P.merge(P.retain(a), P.retain(b)) == P.retain(np.concatenate([a, b]))).all()
    assert P.neighbour_fingerprints(table(spark, [])).count() == 0


def test_toxicity(spark):
    from veilspark.llm.toxicity import is_toxic, score_documents, train

    rnd = random.Random(8)
    words = ["plain%d" % i for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rnd.randrange(60)] = rnd.choice(["idiot", "scum", "pathetic", "grotesk"])
        texts.append(" ".join(w) if i != 1 else None)
        labels.append((i, int(bad)))
    docs = table(spark, texts)
    chain = train(docs.where("doc_id < 400"), spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, toxic int"))
    held = score_documents(docs.where("doc_id >= 400"), chain)
    got = {r["doc_id"]: r["t"] for r in held.select("doc_id", is_toxic(held).alias("t")).collect()}
    truth = dict(labels)
    assert all(not t for i, t in got.items() if not truth[i])
    assert sum(t for i, t in got.items() if truth[i]) >= 0.95 * sum(truth[i] for i in got)
    assert score_documents(table(spark, []), chain).count() == 0
    assert train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).words.max() == 0


def test_html(spark):
    from veilspark.llm.html_wrappers import extract_main_text, infer_wrappers, signature, align, blocks_of, expression

    page = lambda k, extra="": f'<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>m{k}</a></li></ul></nav><div class="ad">buy {k}</div><article><h1>Head {k}</h1><p>One &amp; {k}<br>\n two<p><b>Three {k}</p>{extra}<p>Always here</p><div class="comments"><p>me {k}</p></div></article><aside>side</aside><footer>&copy; {k}</footer></body></html>'
    rows = [(i, f"http://h.example/{i}", page(i, f"<p>more {i}</p>" * (i % 3))) for i in range(6)] + [(9, None, None), (10, "x", ""), (11, "http://o.example/", "<p>bare text<div>cut")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    assert got[0]["text"] == "Head 0\nOne & 0 two\nThree 0\nAlways here" and got[2]["text"].count("more 2") == 2
    assert got[9]["text"] == "" and got[10]["n_chars"] == 0 and got[11]["text"] == "bare text\ncut"
    assert infer_wrappers(pages).count() == 3 and len(got) == 9
    plain = [(i, f"http://p.example/{i}", f"<body><p>Welcome to us</p><h2>T{i}</h2><p>text {i}</p></body>") for i in range(4)]
    bare = extract_main_text(spark.createDataFrame(plain, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in bare} == {f"T{i}\ntext {i}" for i in range(4)}
    both = expression(align(signature(blocks_of(page(1))), signature(blocks_of(page(2, "<p>x</p><p>y</p>")))))
    assert "+" in both and "fixed" in both


def test_html_names_are_hints(spark):
    from veilspark.llm.html_wrappers import extract_main_text

    def page(k):
        inside = f"<h2 id='related-work'>Related {k}</h2><p>a {k}</p><section id='social-history'><h2>History</h2><p>b {k}</p></section><p class='notice'>c {k}</p>"
        site = "<p class='newsletter'>Join us</p><div class='legal-notice'><p>All</p><p>rights</p></div><p>Shared passage</p>"
        other = f"<div class='comments'><p>me {k}</p></div><div class='ad-slot'>buy {k}</div>"
        return f"<body><div class='sidebar'><article><p>teaser {k}</p></article></div><div class='no-sidebar' id='has-widget'><article><h1>T{k}</h1>{inside}{site}{other}</article></div></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(5)]
    rows += [(10, "http://one.example/", page(10))]
    rows += [(20 + i, f"http://p.example/{i}", f"<body><div class='no-sidebar'><p>text {i}</p></div><div class='sidebar'><p>side {i}</p></div></body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == f"T{i}\nRelated {i}\na {i}\nHistory\nb {i}\nc {i}\nShared passage"
    assert got[10] == "T10\nRelated 10\na 10\nHistory\nb 10\nAll\nrights\nShared passage"
    assert all(got[20 + i] == f"text {i}" for i in range(4))


def test_warc(spark):
    from veilspark.llm.warc import RECORD, canonical_url, crawl_of, make_record, parse_records, record_frame, resolve_revisits
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, f"http://Host.example:80/p{i % 4}", f"<p>{i % 2}</p>") for i in range(30)] + [(None, "u", "h"), (99, None, None)], "page_id long, url string, html string")
    records = crawl_of(pages).cache()
    rows = records.collect()
    full = [r for r in rows if r["kind"] == "response"]
    canon = {r["url"]: r["c"] for r in records.select("url", canonical_url(F.col("url")).alias("c")).distinct().collect()}
    for seconds in (600, 10**9):
        got = {r["record_id"]: r for r in resolve_revisits(records, seconds).collect()}
        assert len(got) == sum(r["kind"] == "revisit" for r in rows)
        for r in rows:
            if r["kind"] != "revisit":
                continue
            before = [f for f in full if r["url"] is not None and canon[f["url"]] == canon[r["url"]] and f["ts"] <= r["ts"]]
            last = max(before, key=lambda f: (f["ts"], f["record_id"]), default=None)
            g = got[r["record_id"]]
            if last is None:
                assert g["outcome"] == "missing"
                continue
            tag, old = r["headers"].get("etag"), last["headers"]
            agree = tag.removeprefix("W/") == old["etag"] if tag else r["headers"]["last-modified"] == old["last-modified"] if "last-modified" in r["headers"] else None
            assert g["outcome"] == {True: "resolved", False: "mismatch", None: "unvalidated"}[agree]
            if agree is not False:
                assert g["source_id"] == last["record_id"] and g["headers"]["content-length"] == old["content-length"] and g["headers"]["cache-control"] == r["headers"]["cache-control"]
    assert resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0
    data = make_record("a", "response", "http://x/", "2024-01-01T00:00:00Z", [("ETag", '"1"')], 200, b"body")
    assert len(list(parse_records(data + data[:-20]))) == 1 and len(record_frame([])) == 0


def test_components(spark):
    from veilspark.llm.components import connected_components

    rnd = random.Random(3)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs[:-1]:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "bpe"]
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
    assert docs.count() > 0


def test_long_and_null_ids_stay_apart(spark):
    """Ids that a double cannot hold, beside null."""
    from veilspark.llm.fingerprint import neighbour_fingerprints
    from veilspark.llm.html_wrappers import extract_main_text
    from veilspark.llm.mixing import mix_sources, mixture
    from veilspark.llm.ngram_join import drop_linked, ngram_components

    ids = [(1 << 60) + 1, (1 << 60) + 3, None, 5, 5]
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(i, f"{words} end {k}" if k < 3 else f"other text {k} of its own", "s") for k, i in enumerate(ids)], "doc_id long, text string, source string").coalesce(1)
    some = sorted(ids, key=str)
    assert sorted((r["doc_id"] for r in neighbour_fingerprints(docs).collect()), key=str) == some
    pages = docs.select(docs.doc_id.alias("page_id"), docs.source.alias("url"), docs.text.alias("html"))
    assert sorted((r["page_id"] for r in extract_main_text(pages).collect()), key=str) == some
    groups = ngram_components(docs).collect()
    assert sorted((r["doc_id"] for r in groups), key=str) == some and {r["component_id"] for r in groups if r["n_shingles"] > 30} == {ids[0]}
    assert sorted((r["doc_id"], r["text"][:5]) for r in drop_linked(docs).collect()) == [(5, "other"), (5, "other"), (ids[0], "w0 w1")]
    assert mixture(docs).count() == sum(r["servings"] for r in mix_sources(docs).collect())


def test_every_part_of_a_mix_keeps_the_shares(spark):
    from veilspark.llm.mixing import mixture

    docs = spark.createDataFrame([(i, "a b c d e", "xyz"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    order = [r["source"] for r in mixture(docs).collect()]
    for part in (order[: len(order) // 4], order[-len(order) // 4 :]):
        for s in "xyz":
            assert abs(part.count(s) / len(part) - order.count(s) / len(order)) < 0.05


def test_tables_that_nothing_reads_again_go(spark, tmp_path):
    from veilspark.llm.ngram_join import ngram_components

    before = spark.conf.get(common.CLEANUP)
    kept, gone = (common.materialize(spark.range(5), n) for n in ("kept", "gone"))
    common.discard(gone, None, spark.range(1))
    assert spark.conf.get(common.CLEANUP) == before
    assert kept.count() == 5 and [p.name[:4] for p in (tmp_path / "veilspark").iterdir()] == ["kept"]

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-1], "y"]), "other words than those of the rest", None]
    found = ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    left = {p.name.split("-")[0] for p in (tmp_path / "veilspark").iterdir()}
    assert left == {"kept", "described", "components"}
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    def session(master, **conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert scratch_dir(session("local[2]")) == LOCAL_SCRATCH
    assert scratch_dir(session("spark://host:1", **{"spark.checkpoint.dir": "/shared"})) == "/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session("spark://host:1"))


def test_word_hashes_take_little_memory():
    """The running sums cover a slice of the texts, and a text's words are the same wherever it lies."""
    import tracemalloc

    from veilspark.llm.hashing import word_hashes

    texts = [f"word{k} and others\n" * 100 for k in range(2000)] + ["", " ", "x" * 200_000, "Last \ud800"]
    tracemalloc.start()
    offsets, hashes = word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert np.diff(offsets).tolist() == [300] * 2000 + [0, 0, 1, 2]
    for i in (0, 7, 1999, 2003):
        assert np.array_equal(hashes[offsets[i] : offsets[i + 1]], word_hashes([texts[i]])[1])


@pytest.mark.parametrize("near", [1, 8])
def test_postings_without_a_partner_go(spark, monkeypatch, near):
    """Of a shingle's postings those go that can count for no pair; those of a pair that links all stay."""
    import veilspark.llm.ngram_join as J

    monkeypatch.setattr(J, "NEAR", near)
    # token: (cid, n, pos)
    blocks = {
        1: [(1, 100, 0), (2, 1000, 0)],  # sizes too far apart
        2: [(1, 100, 0), (3, 100, 5)],
        3: [(1, 100, 20), (3, 100, 20)],  # too late in both for a pair to be counted here
        4: [(1, 100, 0)],
        5: [(1, 100, 0), (2, 1000, 0), (3, 110, 0), (4, 1100, 3), (5, 5000, 0)],
        6: [(c, 100 + c, 20) for c in range(12)] + [(99, 9000, 0)],  # a large block goes by sizes
    }
    rows = np.array([(t, n, p, c) for t, b in blocks.items() for c, n, p in b], J.POSTING)
    packed = spark.createDataFrame([(0, J._pack(rows[::2])), (0, J._pack(rows[1::2]))], "bucket int, data binary")
    got = {}
    for r in J.shared(packed).collect():
        got.setdefault(r["token"], set()).add(r["cid"])
    assert got == {2: {1, 3}, 5: {1, 2, 3, 4}, 6: set(range(12))}


def test_ngram_join_takes_few_queries(spark, monkeypatch):
    """Each query costs the driver memory: rounds end when nothing is left, and row counts come with the writes."""
    import veilspark.llm.ngram_join as J

    def last():
        spark.range(1).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-1], "y"]), "other words than those of the rest", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    before = last()
    found = J.ngram_components(docs)
    took = last() - before - 1
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want
    assert took <= 16
    # without proposals the product finds the links
    real = J.proposals
    monkeypatch.setattr(J, "proposals", lambda *a: real(*a).limit(0))
    assert {r["doc_id"]: r["component_id"] for r in J.ngram_components(docs).collect()} == want


def test_measures_come_with_the_write(spark):
    t = spark.range(7).where("id > 1")
    assert common.measured(common.materialize(t, "some", {**common.ROWS, "s": "sum(id)"})) == {"rows": 5, "s": 20}
    assert common.measured(common.materialize(t.join(t.where("id > 90"), "id"), "none", common.ROWS)) == {"rows": 0}
    assert common.measured(common.materialize(t, "plain")) == {}
