"""WARC records and the resolution of not-modified revisits.

A revisit of a 304 answer holds no body. It is resolved as of its time: the latest earlier full response with the same
canonical URL is looked up, the validators are checked, and the headers that a 304 may update are merged into the stored
ones (RFC 9110, RFC 9111).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Header fields of a 304 answer that never replace stored ones.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
RECORD = "record_id string, kind string, profile string, url string, ts timestamp, status int, headers map<string,string>, payload binary, payload_digest string"
#: Seconds of a time bucket: what one task orders of a hot URL is one bucket.
BUCKET_SECONDS = 3600


def payload_digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def make_record(record_id: str, kind: str, url: str, date: str, head: list[tuple[str, str]], status: int, body: bytes = b"", profile: str = "") -> bytes:
    """One WARC/1.1 record with an HTTP answer as its block."""
    http = f"HTTP/1.1 {status} \r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    block = http.encode("utf-8", "surrogatepass") + body
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": url}
    if profile:
        fields["WARC-Profile"] = profile
    fields |= {"WARC-Payload-Digest": payload_digest(body), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _fields(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in data.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = f"{out[last]}, {value.strip()}" if last in out else value.strip()
    return out


def parse_records(data: bytes) -> Iterator[tuple]:
    """The records of a WARC file (plain, or gzip members) as tuples of ``RECORD``; a cut-off record ends the file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            return
        warc = _fields(data[at:head_end])
        length = int(warc.get("content-length", "0") or 0)
        block = data[head_end + 4 : head_end + 4 + length]
        at = head_end + 4 + length
        if len(block) < length:
            return
        status, headers, body = None, {}, block
        if "application/http" in warc.get("content-type", "") and block.startswith(b"HTTP/"):
            http, _, body = block.partition(b"\r\n\r\n")
            line, _, rest = http.partition(b"\r\n")
            parts = line.split(None, 2)
            status = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None
            headers = _fields(rest)
        yield (warc.get("warc-record-id", "").strip("<>"), warc.get("warc-type"), warc.get("warc-profile"), warc.get("warc-target-uri", "").strip("<>") or None, warc.get("warc-date"), status, headers, body, warc.get("warc-payload-digest") or payload_digest(body))


def record_frame(records: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(records, columns=["record_id", "kind", "profile", "url", "ts", "status", "headers", "payload", "payload_digest"])
    frame["ts"] = pd.to_datetime(frame["ts"], utc=True, errors="coerce", format="ISO8601").dt.tz_localize(None).astype("datetime64[us]")
    frame["status"] = frame["status"].astype("Int32")
    return frame


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below ``path``; one file is one unit of work."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield record_frame(list(parse_records(content)))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def canonical_url(url: F.Column) -> F.Column:
    """Scheme and host in lower case, no user, default port or fragment, ``/`` for an empty path; null stays null."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[^/?]*//(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    rest = F.regexp_extract(u, r"^[^/?]*//[^/?]*(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme == "", u).otherwise(F.concat(scheme, F.lit("://"), host, rest))


def _opaque(tag: F.Column) -> F.Column:
    """Weak comparison of entity tags: without the weakness mark."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per not-modified revisit: ``record_id, url, canonical, ts, outcome, source_id, headers, payload_digest``.

    ``records`` has the columns of ``RECORD`` (the payload is not read). Full responses are ``response`` records with
    status 200. Outcomes: ``resolved`` (a validator of both agrees: the entity tag if the revisit has one, else
    Last-Modified), ``unvalidated`` (the revisit names no validator: the stored answer is taken), ``mismatch`` (the
    validator differs or the stored answer lacks it: not merged) and ``missing`` (no earlier full response).

    The as-of join runs in two levels, so that the records of a hot URL never meet in one task: first the last full
    response of each (URL, time bucket), which are scanned per URL, then the order within a bucket. Of equal times, a
    response comes before a revisit, and of several responses the greatest record id is the latest. Null times sort
    first; a null URL matches nothing. Repeated rows give repeated results. Bodies are not moved. An empty table gives
    an empty result. Other columns are ignored.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    revisit = (F.col("kind") == "revisit") & ((F.col("status") == 304) | F.col("profile").contains("server-not-modified"))
    rows = records.select("record_id", "url", canonical_url(F.col("url")).alias("canonical"), "ts", F.coalesce(full, F.lit(False)).alias("full"), F.coalesce(revisit, F.lit(False)).alias("again"), F.coalesce("headers", F.expr("cast(map() as map<string,string>)")).alias("headers"), "payload_digest")
    rows = rows.where("full or again").withColumn("bucket", F.floor(F.unix_seconds("ts") / bucket_seconds))
    rows = materialize(rows, "captures")  # read three times; bodies stay behind
    stored = F.struct(F.col("ts"), F.col("record_id"), F.to_json("headers").alias("headers"), F.col("payload_digest"))
    tops = rows.where("full and canonical is not null").groupBy("canonical", "bucket").agg(F.max(stored).alias("top"))
    keys = rows.select("canonical", "bucket").where("canonical is not null").distinct()
    scan = Window.partitionBy("canonical").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = keys.join(tops.withColumnsRenamed({"canonical": "c2", "bucket": "b2"}), F.col("canonical").eqNullSafe(F.col("c2")) & F.col("bucket").eqNullSafe(F.col("b2")), "left").select(F.col("canonical").alias("c1"), F.col("bucket").alias("b1"), F.last("top", ignorenulls=True).over(scan).alias("earlier"))
    within = Window.partitionBy("canonical", "bucket").orderBy(F.col("ts").asc_nulls_first(), F.col("full").desc(), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("inner", F.last(F.when(F.col("full"), stored), ignorenulls=True).over(within)).where("again")
    placed = placed.join(before, F.col("canonical").eqNullSafe(F.col("c1")) & F.col("bucket").eqNullSafe(F.col("b1")), "left")
    placed = placed.withColumn("src", F.when(F.col("canonical").isNotNull(), F.coalesce("inner", "earlier"))).withColumn("old", F.from_json("src.headers", "map<string,string>"))
    tag, old_tag = _opaque(F.col("headers")["etag"]), _opaque(F.col("old")["etag"])
    date, old_date = F.col("headers")["last-modified"], F.col("old")["last-modified"]
    agrees = F.when(tag.isNotNull(), F.coalesce(tag == old_tag, F.lit(False))).when(date.isNotNull(), F.coalesce(date == old_date, F.lit(False)))
    outcome = F.when(F.col("src").isNull(), "missing").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    permitted = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_zip_with(F.col("old"), permitted, lambda k, a, b: F.coalesce(b, a))
    taken = outcome.isin("resolved", "unvalidated")
    return placed.select("record_id", "url", "canonical", "ts", outcome.alias("outcome"), F.when(taken, F.col("src.record_id")).alias("source_id"), F.when(taken, merged).alias("headers"), F.when(taken, F.col("src.payload_digest")).alias("payload_digest"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """The records of a crawl in which every page is fetched, and asked for again some time later.

    A page is a response at ``page_id`` minutes and a revisit half an hour later. Fragments, upper-case hosts and default
    ports vary the revisit's URL; some revisits carry an outdated tag, only a date, no validator, or a URL never fetched.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for page_id, url, page in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                body = page.encode("utf-8", "surrogatepass")
                tag, k = f'"{hashlib.md5(body).hexdigest()}"', int(page_id)
                at = pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k)
                stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
                modified = (at - pd.Timedelta(days=k % 50)).strftime("%a, %d %b %Y %H:%M:%S GMT")
                head = [("Content-Type", "text/html; charset=utf-8"), ("ETag", tag), ("Last-Modified", modified), ("Content-Length", str(len(body))), ("Cache-Control", "max-age=60")]
                data = make_record(f"urn:page:{k}:a", "response", url, stamp(at), head, 200, body)
                head = [("Date", stamp(at)), ("Cache-Control", f"max-age={k % 90}"), ("Content-Length", "0")]
                if k % 11 == 4:
                    head.append(("ETag", '"outdated"'))
                elif k % 11 == 6:
                    head.append(("Last-Modified", modified))
                elif k % 11 != 7:
                    head.append(("ETag", "W/" + tag))
                again = url.split("#")[0] + "#again" if k % 3 else url
                again = again + "/never" if k % 11 == 9 else again
                data += make_record(f"urn:page:{k}:b", "revisit", again, stamp(at + pd.Timedelta(minutes=30)), head, 304, b"", "http://netpreserve.org/warc/1.1/revisit/server-not-modified")
                out += parse_records(data)
            yield record_frame(out)

    rows = pages.where("page_id is not null").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, RECORD)
