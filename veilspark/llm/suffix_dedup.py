"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

1. Anchors. In every window of ``LENGTH`` bytes the ``GRAM``-byte strings of least hash are anchors; equal windows have
   equal anchors. An anchor's segment is the union of the windows that hold it. A task combines its own equal segments.
2. Classes. Anchors meet by hash. Equal segments form a class: all occurrences but the first repeat it. An anchor with
   one class cannot be part of any other repeat; this is most of a corpus and goes no further.
3. Merge. The first occurrences of the classes of one anchor differ somewhere but may share windows. Their segments are
   cut into shards; each shard's suffixes are sorted once for its transform. All shards are then merged by refining the
   interleave: each round puts suffixes in order of two bytes more, by one stable pass over the transforms. A border that
   first shows after h bytes has a common prefix shorter than that, so after ``LENGTH`` bytes the runs without a border
   are the repeated intervals. Of the windows in a run, all but the first of the corpus are repeats.
4. The repeats of a document are united and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .hashing import mix64, power_table, prefix_sums, span_hashes

LENGTH = 100
GRAM = 32
SHARD = 1 << 16
ANCHOR = np.dtype([("h", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("ver", "<i8"), ("pos", "<i4")])
NO_ID = (1 << 63) - 1
#: A document is its id and a digest of its text.
KEY = ["doc_id", "ver"]
TOP = np.uint64((1 << 64) - 1)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (maximum) of every run of ``width`` values, by prefix and suffix scans of blocks."""
    f = np.minimum if least else np.maximum
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, TOP if least else 0, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = f.accumulate(grid, axis=1).ravel()
    behind = f.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(blobs: list[bytes], docs: list[int], vers: list[int], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The anchors of all documents of at least ``length`` bytes."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    if not len(sizes) or sizes.max() < length:
        return np.empty(0, ANCHOR)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    starts = np.cumsum(sizes) - sizes
    end_of = np.repeat(starts + sizes, sizes)
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    _, inverse = power_table(len(data) + 1)
    grams = mix64((sums[gram:] - sums[:-gram]) * inverse[:n]) & (TOP - np.uint64(1)) | np.uint64(1)
    span = length - gram + 1
    least = _sliding(grams, span, True)
    least[np.arange(len(least)) + length > end_of[: len(least)]] = 0  # a window must not leave its document
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    at = np.flatnonzero(grams == _sliding(padded, span, False)[:n])
    doc = np.searchsorted(starts, at, "right") - 1
    out = np.empty(len(at), ANCHOR)
    left = np.minimum(length - gram, at - starts[doc])
    right = np.minimum(at + length, starts[doc] + sizes[doc])
    out["h"] = grams[at]
    out["seg"] = span_hashes(sums, at - left, right) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (right - at).astype(np.uint64)
    out["doc"] = np.asarray(docs, np.int64)[doc]
    out["ver"] = np.asarray(vers, np.int64)[doc]
    out["pos"] = at - starts[doc]
    return out


def _segment(pos, size, length: int, gram: int):
    return np.maximum(pos - (length - gram), 0), np.minimum(pos + length, size)


def _new_keys(doc: np.ndarray, ver: np.ndarray) -> np.ndarray:
    """Where a document begins in rows in order of document."""
    return np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1])]))


def _pack(doc: np.ndarray, ver: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """(doc_id, ver, spans): the spans of each document as pairs of 32-bit integers."""
    if not len(doc):
        return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "ver": pd.Series(dtype="int64"), "spans": pd.Series(dtype="object")})
    order = np.lexsort((begin, ver, doc))
    doc, ver, pairs = doc[order], ver[order], np.stack([begin[order], end[order]], 1).astype("<i4")
    cuts = _new_keys(doc, ver)
    return pd.DataFrame({"doc_id": doc[cuts], "ver": ver[cuts], "spans": [p.tobytes() for p in np.split(pairs, cuts[1:])]})


def _batches(frames: Iterator[pd.DataFrame], size: int = 1 << 21) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    ids, vers, blobs, n = [], [], [], 0
    for frame in frames:
        for i, v, t in zip(frame["doc_id"], frame["ver"], frame["text"], strict=True):
            ids.append(int(i))
            vers.append(int(v))
            blobs.append((t or "").encode("utf-8", "surrogatepass"))
            n += len(blobs[-1])
            if n >= size:
                yield ids, vers, blobs
                ids, vers, blobs, n = [], [], [], 0
    if ids:
        yield ids, vers, blobs


def _first_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors in order of hash, segment and place, each once, and which of them are the first of their class."""
    rows = rows[np.lexsort((rows["pos"], rows["ver"], rows["doc"], rows["seg"], rows["h"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["seg"][1:] != rows["seg"][:-1])
    own = first.copy()  # the same place again is a row that repeats its document, not an occurrence
    own[1:] |= (rows["doc"][1:] != rows["doc"][:-1]) | (rows["ver"][1:] != rows["ver"][:-1]) | (rows["pos"][1:] != rows["pos"][:-1])
    return rows[own], first[own]


#: A span that reaches to the end of its document, whatever that is: clipped when it is applied.
def _repeat_spans(rows: np.ndarray, length: int, gram: int) -> pd.DataFrame:
    begin, end = _segment(rows["pos"].astype(np.int64), 1 << 31, length, gram)
    return _pack(rows["doc"], rows["ver"], begin, np.minimum(end, (1 << 31) - 1))


def anchor_rows(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """(bucket, data, doc_id, ver, spans): packed first anchors by hash bucket, and repeats within the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> Iterator[pd.DataFrame]:
            rows, first = _first_of(np.concatenate(held))
            held.clear()
            if not first.all():
                spans = _repeat_spans(rows[~first], length, gram)
                yield pd.DataFrame({"bucket": (mix64((spans["doc_id"] ^ spans["ver"]).to_numpy().astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), "data": None, **spans})
            rows = rows[first]
            bucket = (rows["h"] >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order].astype(np.int32)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            yield pd.DataFrame({"bucket": bucket[cuts], "data": [p.tobytes() for p in np.split(rows, cuts[1:])], "doc_id": 0, "ver": 0, "spans": None})

        for ids, vers, blobs in _batches(frames):
            rows = find_anchors(blobs, ids, vers, length, gram)
            if len(rows):
                held.append(rows)
                size += len(rows)
            if size > 400_000:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return docs.mapInPandas(run, "bucket int, data binary, doc_id long, ver long, spans binary")


CANDIDATE = np.dtype([("h", "<u8"), ("pos", "<i4")])


def classes(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, ver, spans, first): repeats of whole segments, and the first occurrences whose anchor has several classes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"doc_id": frame["doc_id"], "ver": frame["ver"], "spans": frame["spans"], "first": None})[frame["spans"].notna()]]
        packed = [d for d in frame["data"] if d is not None]
        if packed:
            rows, first = _first_of(np.frombuffer(b"".join(packed), ANCHOR))
            if not first.all():
                out.append(_repeat_spans(rows[~first], length, gram).assign(first=None))
            reps = rows[first]
            same = reps["h"][1:] == reps["h"][:-1]
            reps = reps[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(reps) > 1 else reps[:0]
            if len(reps):
                reps = reps[np.lexsort((reps["ver"], reps["doc"]))]
                cuts = _new_keys(reps["doc"], reps["ver"])
                cand = np.empty(len(reps), CANDIDATE)
                cand["h"], cand["pos"] = reps["h"], reps["pos"]
                out.append(pd.DataFrame({"doc_id": reps["doc"][cuts], "ver": reps["ver"][cuts], "spans": None, "first": [p.tobytes() for p in np.split(cand, cuts[1:])]}))
        return pd.concat(out)

    return rows.groupBy("bucket").applyInPandas(run, "doc_id long, ver long, spans binary, first binary")


def suffix_order(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, suffix array, rank) of the segments, each with an end mark of its own below all bytes; marks read 0.

    The first key holds seven symbols of nine bits; ranks then double their reach until every suffix is alone.
    """
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    text = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8).astype(np.int64) + 1
    text[np.cumsum(sizes) - 1] = 0
    n = len(text)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # symbols to the end of the segment, its mark included
    key = np.zeros(n, np.int64)
    for i in range(7):
        key <<= 9
        if i < n:
            key[: n - i] |= np.where(left[: n - i] > i, text[i:], 0)
    order = np.argsort(key, kind="stable")
    shown = key[order]
    new = np.ones(n, np.int64)
    new[1:] = (shown[1:] != shown[:-1]) | (shown[1:] & 511 == 0)  # a key that reaches its mark is alone
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    k = 7
    while rank[order[-1]] < n - 1:
        key = rank * n
        key[:-k] += rank[k:]
        order = np.argsort(key)
        shown = key[order]
        new = np.cumsum(np.concatenate([[0], shown[1:] != shown[:-1]]))
        rank[order] = new
        k *= 2
    return text, order, rank


def repeated_windows(segments: list[bytes], docs: np.ndarray, begins: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every window of the segments that also occurs earlier among them.

    The interleave holds suffixes by their places in the shards' orders. A round takes from each place's transform the
    two symbols before it (``symbols``), puts the suffixes so extended in order by one stable pass, and steps to their
    places (``before``). Runs without a border share a prefix of as many bytes as have been put before them. A suffix
    alone in its run stays alone and leaves; only suffixes that extend to a whole window take part.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes + 1) // shard, prepend=-1))
    symbols, before, owner, offset, start = [], [], [], [], []
    base = 0
    for a, b in zip(cuts, [*cuts[1:], len(segments)], strict=True):
        text, order, rank = suffix_order(segments[a:b])
        n = len(text)
        two = (order - 2) % n
        symbols.append(((text[order - 1] & 255) | ((text[two] & 255) << 8)).astype(np.uint16))  # a byte b reads b + 1 modulo 256
        before.append(rank[two].astype(np.int32) + base)
        which = np.repeat(np.arange(a, b, dtype=np.int32), sizes[a:b] + 1)
        inner = np.arange(n) - np.repeat(np.cumsum(sizes[a:b] + 1) - (sizes[a:b] + 1), sizes[a:b] + 1)
        owner.append(which[order])
        offset.append(inner[order].astype(np.int32))
        start.append(np.flatnonzero(offset[-1] >= length) + base)
        base += n
    symbols, before = np.concatenate(symbols), np.concatenate(before)
    at = np.concatenate(start)
    run = np.zeros(len(at), np.int64)
    for _ in range(length // 2):
        if len(at) < 2:
            at, run = at[:0], run[:0]
            break
        here = symbols[at]
        perm = np.argsort(here, kind="stable")
        here, run, at = here[perm], run[perm], before[at[perm]]
        border = np.ones(len(at) + 1, bool)
        border[1:-1] = (here[1:] != here[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(border[:-1])
        shared = ~(border[:-1] & border[1:])
        if not shared.all():
            run, at = run[shared], at[shared]
    if not len(at):
        return docs[:0], begins[:0]
    seg, off = np.concatenate(owner)[at], np.concatenate(offset)[at]
    doc, begin = docs[seg], begins[seg] + off
    order = np.lexsort((begin, doc, run))
    run, doc, begin = run[order], doc[order], begin[order]
    head = np.flatnonzero(np.diff(run, prepend=-1))
    to = np.repeat(head, np.diff(np.concatenate([head, [len(run)]])))
    again = (doc != doc[to]) | (begin != begin[to])
    return doc[again], begin[again]


def merged_spans(docs: DataFrame, firsts: DataFrame, buckets: int, length: int, gram: int, shard: int) -> DataFrame:
    """(doc_id, ver, spans) of the windows that first occurrences share with earlier ones."""
    per_doc = firsts.groupBy(*KEY).agg(F.collect_list("first").alias("first"))
    rows = docs.join(per_doc, KEY).select(*KEY, "text", "first")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, ver, text, first in zip(frame["doc_id"], frame["ver"], frame["text"], frame["first"], strict=True):
                blob = (text or "").encode("utf-8", "surrogatepass")
                for c in np.frombuffer(b"".join(first), CANDIDATE):
                    a, b = _segment(int(c["pos"]), len(blob), length, gram)
                    out.append((int((int(c["h"]) >> 32) % buckets), int(doc), int(ver), int(a), blob[a:b]))
            yield pd.DataFrame(out, columns=["bucket", "doc_id", "ver", "begin", "segment"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        ids, vers = frame["doc_id"].to_numpy(), frame["ver"].to_numpy()
        order = np.lexsort((vers, ids))
        heads = _new_keys(ids[order], vers[order])
        number = np.empty(len(ids), np.int64)  # documents in order of id and text
        number[order] = np.repeat(np.arange(len(heads)), np.diff([*heads, len(ids)]))
        ids, vers = ids[order][heads], vers[order][heads]
        doc, start = repeated_windows(list(frame["segment"]), number, frame["begin"].to_numpy(), length, shard)
        if not len(doc):
            return _pack(doc, doc, start, start)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])  # runs of neighbouring starts
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(doc)]]) - 1
        return _pack(ids[doc[at]], vers[doc[at]], start[at], start[last] + length)

    pieces = rows.mapInPandas(cut, "bucket int, doc_id long, ver long, begin int, segment binary").dropDuplicates()
    return pieces.groupBy("bucket").applyInPandas(join, "doc_id long, ver long, spans binary")


def unite(spans: list[bytes], size: int) -> np.ndarray:
    """Maximal runs [begin, end) of the union of packed spans, within ``size`` bytes."""
    pairs = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).astype(np.int64)
    pairs = np.minimum(pairs[np.argsort(pairs[:, 0], kind="stable")], size)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    if not len(pairs):
        return pairs
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([pairs[at, 0], reach[np.concatenate([at[1:], [len(pairs)]]) - 1]], 1)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """Cut out each byte covered by a ``length``-byte string that also starts earlier (smaller id, or earlier start).

    One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary). Strings are judged on the input;
    overlaps count; matches never cross documents. Null text counts as empty. A null id comes last and stays null. Rows
    that repeat an id (or null) and its text are one document that is returned for each row; different texts under one id
    (or null) are documents of their own, in order of a digest of their text. An empty table gives an empty result. Other
    columns are ignored. ``length`` must be even.
    """
    if length % 2 or gram > length:
        raise ValueError("length must be even and at least gram")
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("ver", F.xxhash64("text"))
    buckets = 4 * shuffle_partitions(df.sparkSession)
    found = materialize(classes(anchor_rows(docs, buckets, length, gram), length, gram), "classes")
    merged = materialize(merged_spans(docs, found.where("first is not null").select(*KEY, "first"), 2 * buckets, length, gram, shard), "merged")
    spans = found.where("spans is not null").select(*KEY, "spans").unionByName(merged)
    per_doc = spans.groupBy(*KEY).agg(F.collect_list("spans").alias("spans"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, packed in zip(frame["doc_id"], frame["text"], frame["spans"], strict=True):
                blob = (text or "").encode("utf-8", "surrogatepass")
                gone = unite(list(packed), len(blob)) if packed is not None else np.empty((0, 2), np.int64)
                kept, at = [], 0
                for a, b in gone.tolist():
                    kept.append(blob[at:a])
                    at = b
                kept.append(blob[at:])
                out.append((int(doc), len(blob), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), b"".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.join(per_doc, KEY, "left").select("doc_id", "text", "spans")
    out = joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


