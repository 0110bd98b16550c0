"""Jaccard join on word shingles as a blocked sparse product of the document-by-shingle incidence matrix.

Documents with the same shingle set are one class, so copies are never expanded. Shingles are ordered by how frequent
they are, then by hash; of a set of n only the first ``n - ceil(0.8 n) + 1`` can matter for finding a partner. The
incidence restricted to these prefixes falls into blocks by shingle; blocks of one class go no further.

1. Representatives. In every block that holds several components, the others meet a representative of one component; each
   class proposes the representative that it shares most blocks with. Proposals are compared in full, what links becomes
   one component, and blocks within one component are done. A family of near copies thus costs a pair a member, not a
   pair of members.
2. Product. Blocks that still hold several components are multiplied out between components, in tiles of bounded size.
   For sets of a and b shingles with least overlap ``need``, the first ``a - need + 1 + l`` and ``b - need + 1 + l``
   shingles of two sets that link share at least ``l + 1``. A tile passes on a pair only where the shingle lies within
   both of these; overlap counts accumulate over all tiles, and pairs below ``l + 1`` are discarded.
3. The pairs left are compared in full. A set is sent once to each star that its class takes part in.

No link between different components is lost, and pairs within a component are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS, discard, materialize, measured, shuffle_partitions, trimmed
from .components import connected_components
from .hashing import mix64, word_hashes, word_shingles

WIDTH = 5
#: Links need ``100 * intersection >= 80 * union``.
PERCENT = 80
#: Slots of the frequency table, a fixed size at any scale; it only orders shingles and never decides a link.
SLOT_BITS = 24
PARTS = 64
#: Rounds of representatives before the product; more of them save pairs, none changes a result.
ROUNDS = 3
#: Representatives of a component in a block, and how many of them a class is compared with in a round.
HEADS = 8
BEST = 2
#: A tile of the product has at most about so many rows outside its block's largest component, and so many rows at all.
TILE_ROWS = 256
TILE_COLUMNS = 4096
#: Members of a star that meet their representative in one task.
STAR = 64
#: Rows (class, star, id) up to which texts are looked up by broadcast; beyond, by a shuffled join.
LOOKUP_ROWS = 200_000


def need_of(a, b):
    """The least overlap at which sets of a and b shingles link."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def prefix_of(n):
    return n - (PERCENT * n + 99) // 100 + 1


def slack_of(a, b, need):
    """``l``: half of what the stored prefixes allow beyond the least ones, between few pairs and sharp counts."""
    return np.maximum((need - (PERCENT * np.maximum(a, b) + 99) // 100) // 2, 0)


def _sets(texts: list) -> Iterator[np.ndarray]:
    texts = [t or "" for t in texts]
    offsets, hashes = word_hashes(texts)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield word_shingles(hashes[a:b], WIDTH)


def _set_id(shingles: np.ndarray) -> int:
    factors = mix64(np.arange(1, len(shingles) + 1, dtype=np.uint64))
    total = (shingles * (factors | np.uint64(1))).sum(dtype=np.uint64) ^ shingles.sum(dtype=np.uint64)
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def _rows(batches: Iterator[pa.RecordBatch], size: int = 1 << 21) -> Iterator[list[tuple]]:
    """Rows in lists of about ``size`` characters of their last column, so that buffers stay small whatever the lengths
    are. Values stay as Arrow has them: a null beside a long turns nothing into a float."""
    held, n = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            n += len(row[-1] or "")
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


DESCRIBED = pa.schema([("doc_id", pa.int64()), ("ver", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])


def describe(docs: DataFrame) -> DataFrame:
    """Pass 1: a row (doc_id, ver, n, cid) per document, and per task the counts of its classes' shingles by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int32)
        seen: set[int] = set()
        for rows in _rows(batches):
            sizes, cids = [], []
            for s in _sets([r[-1] for r in rows]):
                cid = _set_id(s) if len(s) else None
                sizes.append(len(s))
                cids.append(cid)
                if len(s) and cid not in seen:
                    seen.add(cid)
                    np.add.at(counts, _slots(s), 1)
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([r[0] for r in rows], [r[1] for r in rows], sizes, cids, none, none), DESCRIBED, strict=True)], schema=DESCRIBED)
        if seen:
            parts = [pa.compress(c.tobytes(), "zstd", asbytes=True) for c in np.split(np.minimum(counts, 255).astype(np.uint8), PARTS)]
            none = [None] * PARTS
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((none, none, none, none, range(PARTS), parts), DESCRIBED, strict=True)], schema=DESCRIBED)

    return docs.mapInArrow(trimmed(run), "doc_id long, ver long, n long, cid long, part int, counts binary")


def levels(described: DataFrame) -> np.ndarray:
    """For each slot, four times the binary logarithm of its count over all documents (of each task at most 255)."""
    size = (1 << SLOT_BITS) // PARTS

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, c in zip(frame["part"], frame["counts"], strict=True):
                total = totals.setdefault(int(part), np.zeros(size, np.int64))
                total += np.frombuffer(pa.decompress(c, size, "zstd", asbytes=True), np.uint8)
        for part, total in totals.items():
            level = np.floor(4 * np.log2(1 + total)).astype(np.uint8)
            yield pd.DataFrame({"part": [part], "level": [pa.compress(level.tobytes(), "zstd", asbytes=True)]})

    parts = described.where("part is not null").select("part", "counts").repartition(PARTS, "part")
    table = np.zeros((PARTS, size), np.uint8)
    for r in parts.mapInPandas(add, "part int, level binary").collect():  # PARTS rows of a fixed size
        table[r["part"]] = np.frombuffer(pa.decompress(r["level"], size, "zstd", asbytes=True), np.uint8)
    return table.ravel()


#: The lower half of a mixed shingle hash; the upper half gives the bucket. Hashes that agree in both can add to a count,
#: never take from it.
POSTING = np.dtype([("token", "<u4"), ("n", "<i4"), ("pos", "<i4"), ("cid", "<i8")])


def _pack(rows: np.ndarray) -> bytes:
    """The rows' number, then their bytes, all first bytes first: small numbers leave long runs of zeros."""
    planes = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.itemsize).T
    return len(rows).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], n * POSTING.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(POSTING.itemsize, n).T).view(POSTING).ravel()


def postings(docs: DataFrame, level, buckets: int) -> DataFrame:
    """Pass 2: (bucket, data) rows of packed prefix postings; a class is sent once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, held, tokens, size = level.value, set(), [], [], 0

        def flush() -> pa.RecordBatch:
            rows, token = np.concatenate(held), mix64(np.concatenate(tokens))
            held.clear()
            tokens.clear()
            rows["token"] = token.astype(np.uint32)
            bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([_pack(p) for p in np.split(rows, cuts[1:])], pa.binary())], names=["bucket", "data"])

        for rows in _rows(batches):
            for s in _sets([t for (t,) in rows]):
                n = len(s)
                if not n or (cid := _set_id(s)) in seen:
                    continue
                seen.add(cid)
                own = np.empty(prefix_of(n), POSTING)
                tokens.append(s[np.argsort(table[_slots(s)], kind="stable")[: len(own)]])
                own["cid"], own["n"], own["pos"] = cid, n, np.arange(len(own))
                held.append(own)
                size += len(own)
            if size > 300_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(trimmed(run), "bucket int, data binary")


#: Blocks of at most one row more than this have their pairs tried one by one in ``shared``.
NEAR = 8


def _suited(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sizes of two postings of one shingle allow a link, and their positions that this block counts for it."""
    need = need_of(a["n"], b["n"])
    slack = slack_of(a["n"], b["n"], need)
    sizes = PERCENT * np.maximum(a["n"], b["n"]) <= 100 * np.minimum(a["n"], b["n"])
    return sizes & (a["pos"] <= a["n"] - need + slack) & (b["pos"] <= b["n"] - need + slack)


def shared(packed: DataFrame) -> DataFrame:
    """(token, cid, n, pos): the postings of shingles that at least two classes have.

    A posting stays only if the block holds another one that it can count with: a pair that links shares enough blocks in
    which both are suited, and there both stay. Large blocks keep what a neighbour in the order of sizes allows.
    """

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.unique(np.concatenate([_unpack(d) for d in frame["data"]]))
        rows = rows[np.lexsort((rows["cid"], rows["n"], rows["token"]))]
        at = np.arange(len(rows))
        new = np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])
        begin = np.maximum.accumulate(np.where(new, at, 0))
        block = np.cumsum(new) - 1
        large = np.bincount(block)[block] > NEAR + 1
        stays = np.zeros(len(rows), bool)
        for d in range(1, NEAR + 1):
            j = at[d:][begin[d:] <= at[:-d]]  # and j - d, in one block
            a, b = rows[j - d], rows[j]
            ok = np.where(large[j], (PERCENT * b["n"] <= 100 * a["n"]) & (d == 1), _suited(a, b) & (a["cid"] != b["cid"]))
            stays[j[ok]] = stays[j[ok] - d] = True
        rows = rows[stays]
        token = (np.int64(frame["bucket"].iloc[0]) << np.int64(32)) | rows["token"].astype(np.int64)
        return pd.DataFrame({"token": token, "cid": rows["cid"], "n": rows["n"], "pos": rows["pos"]})

    return packed.groupBy("bucket").applyInPandas(keep, "token long, cid long, n int, pos int")


def _rank(col: str | F.Column, salt: int) -> F.Column:
    return F.xxhash64(col, F.lit(salt))


#: Bits of a class id that a representative is known by.
SHORT = 57


def _short(cid: F.Column) -> F.Column:
    return F.shiftrightunsigned(cid, 64 - SHORT)


def _mask(salt: int) -> F.Column:
    """Class ids are hashes, so that their order after this exclusive or is another one for each salt."""
    return F.lit(((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - SHORT)).cast("long")


def nodes_of(places: DataFrame) -> DataFrame:
    """(cid, n, level): classes of the blocks, and how much of a class's prefix other classes have, in 63 steps.

    The members of a family with few changes of their own have most of it; they link with most others.
    """
    nodes = places.groupBy("cid").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("s"))
    prefix = F.expr(f"n - ({PERCENT}L * n + 99) div 100 + 1")
    return nodes.select("cid", "n", F.least(F.floor(F.col("s") * 63 / prefix), F.lit(63)).cast("int").alias("level"))


def unresolved(places: DataFrame, nodes: DataFrame, found: DataFrame | None, salt: int) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks) of the blocks with several components.

    ``rows`` has each posting's component and level; ``blocks`` has per token its rows, the rows outside its main
    component, and representatives of that: for each of ``HEADS`` orders the first member of the highest level. The main
    component is the largest one; of equal ones, which all are at first, that of the first representative. Blocks within
    one component are left out before anything else moves: components only grow, so the next round needs no more than
    ``rows`` either.
    """
    rank = lambda k: F.shiftleft(F.col("level").cast("long"), SHORT).bitwiseOR(_short(F.col("cid")).bitwiseXOR(_mask(salt + k)))
    known = lambda h, k: F.col(h).bitwiseAND(F.lit((1 << SHORT) - 1)).bitwiseXOR(_mask(salt + k))
    if found is None:  # each class is a component of its own, and each block has several
        rows = places.join(nodes.select("cid", "level"), "cid").withColumn("component", F.col("cid"))
        first = rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct(rank(0).alias("h"), "cid")).alias("m"))
        return rows, first.select("token", "rows", (F.col("rows") - 1).alias("outside"), F.col("m.cid").alias("main"), F.array(known("m.h", 0)).alias("heads"))
    nodes = nodes.join(found.withColumnRenamed("node", "cid"), "cid", "left")
    rows = places.join(nodes.select("cid", "level", F.coalesce("component", "cid").alias("component")), "cid")
    several = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rows = materialize(rows.join(several, "token", "left_semi"), "unresolved", ROWS)
    heads = [f"h{k}" for k in range(HEADS)]
    parts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"), *[F.max(rank(k)).alias(h) for k, h in enumerate(heads)])
    blocks = parts.groupBy("token").agg(F.sum("k").alias("rows"), F.max(F.struct("k", *heads, "component")).alias("main"))
    return rows, blocks.select("token", "rows", (F.col("rows") - F.col("main.k")).alias("outside"), F.col("main.component").alias("main"), F.array_distinct(F.array(*[known(f"main.{h}", k) for k, h in enumerate(heads)])).alias("heads"))


def proposals(rows: DataFrame, blocks: DataFrame, nodes: DataFrame, tested: DataFrame | None) -> DataFrame:
    """(a, b): for each class outside the main components of its blocks, the ``BEST`` representatives that it shares most
    blocks with, of those with a suitable size."""
    met = rows.join(blocks.select("token", "main", "heads"), "token").where("component != main").select("cid", "n", F.explode("heads").alias("h"))
    counted = met.groupBy(F.col("cid").alias("a"), "h").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    counted = counted.join(nodes.select(_short(F.col("cid")).alias("h"), F.col("cid").alias("b"), F.col("n").alias("nb"), "level"), "h")
    counted = counted.where(F.lit(PERCENT) * F.greatest("n", "nb") <= F.lit(100) * F.least("n", "nb"))
    if tested is not None:
        counted = _untested(counted, tested)
    first = F.row_number().over(Window.partitionBy("a").orderBy(F.col("c").desc(), F.col("level").desc(), "b"))
    return counted.withColumn("__k", first).where(F.col("__k") <= BEST).select("a", "b")


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    known = tested.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return pairs.join(known, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<i4"), ("nb", "<i4"), ("c", "<i4")])


def _summed(pairs: np.ndarray) -> np.ndarray:
    """Equal pairs become one, with the sum of their counts."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    first = np.flatnonzero(np.concatenate([[True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])]))
    out = pairs[first]
    out["c"] = np.add.reduceat(pairs["c"], first)
    return out


class _Product:
    """Overlap counts of pairs from the tiles of a task, combined whenever many have come in."""

    def __init__(self, limit: int = 1 << 20):
        self.held, self.size, self.limit = [], 0, limit

    def add(self, g: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of rows i and j that differ in component and pass the bounds of sizes and positions."""
        ok = (g["component"][i] != g["component"][j]) & (PERCENT * np.maximum(g["n"][i], g["n"][j]) <= 100 * np.minimum(g["n"][i], g["n"][j]))
        i, j = i[ok], j[ok]
        a, b = g["n"][i], g["n"][j]
        need = need_of(a, b)
        slack = slack_of(a, b, need)
        ok = (g["pos"][i] <= a - need + slack) & (g["pos"][j] <= b - need + slack)
        i, j = i[ok], j[ok]
        swap = g["cid"][i] > g["cid"][j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pairs = np.empty(len(i), PAIR)
        pairs["a"], pairs["b"], pairs["na"], pairs["nb"], pairs["c"] = g["cid"][i], g["cid"][j], g["n"][i], g["n"][j], 1
        self.held.append(pairs)
        self.size += len(pairs)
        if self.size > self.limit:
            self.held = [_summed(np.concatenate(self.held))]
            self.size = len(self.held[0])
            self.limit = max(self.limit, 2 * self.size)

    def take(self) -> np.ndarray:
        return _summed(np.concatenate(self.held)) if self.held else np.empty(0, PAIR)


def products(rows: DataFrame, blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, data): packed overlap counts of pairs between components, from tiles of the unresolved blocks."""
    down = F.ceil(F.col("outside") / F.lit(TILE_ROWS)).cast("int")
    across = F.ceil(F.col("rows") / F.lit(TILE_COLUMNS)).cast("int")
    placed = rows.join(blocks.select("token", "main", down.alias("down"), across.alias("across")), "token").withColumn("out", F.col("component") != F.col("main"))
    row, column = F.pmod(_rank("cid", 1), "down").cast("int"), F.pmod(_rank("cid", 2), "across").cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_column = F.transform(every("down"), lambda r: F.struct(r.alias("i"), column.alias("j"), F.lit(False).alias("lead")))
    as_row = F.transform(every("across"), lambda c: F.struct(row.alias("i"), c.alias("j"), F.lit(True).alias("lead")))
    one = (F.col("down") == 1) & (F.col("across") == 1)  # a block of one tile: its rows meet one another
    tiles = F.when(one | ~F.col("out"), as_column).otherwise(F.concat(as_column, as_row))
    placed = placed.withColumn("t", F.explode(tiles)).select("token", "cid", "n", "pos", "component", "out", "t.i", "t.j", "t.lead", one.alias("one"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("token", "i", "j"), F.lit(buckets)).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["token", "i", "j"], kind="stable")
        g = {c: frame[c].to_numpy() for c in ("token", "i", "j", "cid", "n", "pos", "component", "out", "lead", "one")}
        start = np.flatnonzero(np.concatenate([[True], (g["token"][1:] != g["token"][:-1]) | (g["i"][1:] != g["i"][:-1]) | (g["j"][1:] != g["j"][:-1])]))
        size = np.diff(np.append(start, len(frame)))
        pairs = _Product()
        plain = g["one"][start]
        for k in np.unique(size[plain]):  # blocks of one tile, all of one size at once
            i, j = np.triu_indices(k, 1)
            at = start[plain & (size == k)]
            for part in np.array_split(at, max(1, len(at) * len(i) // 1_000_000)):
                pairs.add(g, (part[:, None] + i).ravel(), (part[:, None] + j).ravel())
        for s, k in zip(start[~plain], size[~plain], strict=True):
            here = np.arange(s, s + k)
            lead, others = here[g["lead"][s : s + k]], here[~g["lead"][s : s + k]]
            for x in lead:  # two rows outside the main component meet once
                pairs.add(g, np.full(len(others), x), others) if not g["out"][others].any() else pairs.add(g, *_once(g, x, others))
        made = pairs.take()
        to = (mix64(made["a"].view(np.uint64) if made["a"].flags.c_contiguous else np.ascontiguousarray(made["a"]).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        made, to = made[order], to[order]
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        return pd.DataFrame({"bucket": to[cuts], "data": [p.tobytes() for p in np.split(made, cuts[1:])] if len(cuts) else []})

    return placed.groupBy("bucket").applyInPandas(run, "bucket int, data binary")


def _once(g: dict[str, np.ndarray], x: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    others = others[~g["out"][others] | (g["cid"][others] > g["cid"][x])]
    return np.full(len(others), x), others


def survivors(packed: DataFrame) -> DataFrame:
    """(a, b): pairs whose count over all tiles reaches the bound that their sizes give."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = _summed(np.frombuffer(b"".join(frame["data"]), PAIR))
        need = need_of(pairs["na"], pairs["nb"])
        pairs = pairs[pairs["c"] > slack_of(pairs["na"], pairs["nb"], need)]
        return pd.DataFrame({"a": pairs["a"], "b": pairs["b"]})

    return packed.groupBy("bucket").applyInPandas(run, "a long, b long")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by comparing whole sets, as a table in the shared folder.

    The pairs of one ``b`` are a star: its members meet it in groups of about ``STAR``, to which texts are sent, a text
    once per group. The looked-up rows are counted first: few are broadcast to the documents, many are joined by shuffle.
    """
    stars = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    members = pairs.join(stars, "b").select(F.col("b").alias("hub"), F.pmod(_rank("a", 3), F.ceil(F.col("k") / F.lit(STAR))).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("cid"))
    heads = members.select("hub", "salt").distinct().select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("cid"))
    wanted = materialize(members.unionByName(heads).join(classes.select("cid", F.col("doc_id").alias("__w")), "cid"), "wanted", ROWS)
    lookup = F.broadcast(wanted) if measured(wanted)["rows"] <= LOOKUP_ROWS else wanted
    rows = docs.join(lookup, F.col("doc_id").eqNullSafe(F.col("__w"))).select("hub", "salt", "role", "cid", "text")
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, head = None, None
        for rows in _rows(batches):
            a, b = [], []
            for (hub, salt, role, cid, _), s in zip(rows, _sets([r[-1] for r in rows]), strict=True):
                if not len(s) or _set_id(s) != cid:
                    continue  # another text under the same id
                if role == 0:
                    place, head = (hub, salt), s
                elif place == (hub, salt):
                    both = np.intersect1d(head, s, assume_unique=True).size
                    if 100 * both >= PERCENT * (len(head) + len(s) - both):
                        a.append(cid)
                        b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)

    linked = materialize(rows.mapInArrow(trimmed(run), "a long, b long").distinct(), "links", ROWS)
    discard(wanted)
    return linked


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_shingles, class_id, component_id``, and ``group_id`` (one per component, null of an
    empty set) and ``ver`` (a digest of the text).

    ``class_id`` is the least id of the documents with the same shingle set, ``component_id`` the least id reachable by
    links, both the document's own id where its set is empty (null, empty or blank texts link with nothing). Shingles are
    runs of five words (A-Z lower-cased); a shorter text is one shingle. Rows that repeat an id are documents of their
    own that share the id. A null id is a document whose component is that of its class; ids may be any longs. Very long
    texts are taken whole; a worker holds about two million characters, or one text, at a time. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(describe(docs.select("doc_id", F.xxhash64("text").alias("ver"), "text")), "described")
    level = spark.sparkContext.broadcast(levels(described))  # 2**SLOT_BITS bytes
    meta = described.where("part is null").select("doc_id", "ver", "n", "cid")
    classes = meta.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    buckets = 4 * shuffle_partitions(spark)
    places = materialize(shared(postings(docs, level, buckets)), "postings")
    level.destroy()
    nodes = materialize(nodes_of(places), "nodes")
    found = tested = None
    held, done, k = places, [nodes], 0
    while k <= ROUNDS:
        rows, blocks = unresolved(places, nodes, found, HEADS * k)
        if k:  # a table of its own, which replaces the one it was made from
            discard(held)
            held = rows
            if not measured(rows)["rows"]:
                break
        places = rows.select(*places.columns)
        if k < ROUNDS:
            pairs = materialize(proposals(rows, blocks, nodes, tested), "pairs", ROWS)
            done.append(pairs)
            if k and not measured(pairs)["rows"]:  # no representative is left to meet
                k = ROUNDS
        if k == ROUNDS:
            blocks = materialize(blocks, "blocks")
            pairs = survivors(products(rows, blocks, buckets))
            pairs = materialize(_untested(pairs, tested), "pairs", ROWS)
            done.append(pairs)
            discard(held, blocks)
        tested = pairs if tested is None else tested.unionByName(pairs)
        made = verify(pairs, docs, classes) if measured(pairs)["rows"] else pairs
        done.append(made)
        if found is None:
            found = connected_components(made)
        elif measured(made)["rows"]:  # what is known already is a star to each component, and new links join stars
            earlier, found = found, connected_components(made.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            discard(earlier)
        k += 1
    done.append(held)
    discard(*done)  # what follows reads only the descriptions and the components
    by_class = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "doc_id", F.coalesce("component", "cid").alias("component"))
    least = by_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    verdict = by_class.join(least, "component").select("cid", F.col("doc_id").alias("class_id"), "component_id", F.col("component").alias("group_id"))
    out = meta.join(verdict, "cid", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "group_id", "ver")


def drop_linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of linked rows one row, all columns: one with the least id (a null id is the last), then the least
    digest of its text. Rows without words stay. Rows are told apart by id and digest; of rows that repeat both one stays.
    """
    groups = ngram_components(df, id_col, text_col)
    key = lambda i: F.xxhash64(i, i.isNull())
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "ver")
    heads = groups.where("group_id is not null").groupBy("group_id").agg(F.min(place).alias("p")).select(key(F.col("p.id")).alias("__i"), F.col("p.ver").alias("__v"))
    heads = heads.unionByName(groups.where("group_id is null").select(key(F.col(id_col)).alias("__i"), F.col("ver").alias("__v")).distinct())
    text = F.col(text_col).cast("string")
    rows = df.withColumn("__i", key(F.col(id_col).cast("long"))).withColumn("__v", F.xxhash64(text)).dropDuplicates(["__i", "__v"])
    return rows.join(heads, ["__i", "__v"], "left_semi").drop("__i", "__v")
