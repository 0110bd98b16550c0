"""Token ids in files of fixed-width bit-packed blocks.

A file (an *image*) holds the ids of consecutive documents. Layout, little-endian::

    8 s  magic "VSBITS01"          4 u  bits an id        4 u  ids in a block
    8 u  number of documents       8 u  number of ids     8 u  number of blocks
    number of documents * 8 s      document ids (minimum long: null)
    (number of documents + 1) * 8  offset of each document's first id
    (number of blocks + 1) * 8     byte offset of each block within the payload
    payload                        each block: its ids, ``bits`` bits each, lowest bit first, filled to whole bytes

Block offsets give random access: an id range is read from the blocks that hold it. Images travel as rows of a Parquet
table, so that Spark's commit protocol makes a write whole or absent and any file system Spark knows can hold them.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import placed, range_bucket, shuffle_partitions, trimmed

MAGIC = b"VSBITS01"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK = 4096
#: Ids that the reader unpacks at once.
READ_IDS = 1 << 18
#: Ids in an image before the next one begins; a document is never split.
IMAGE_IDS = 1 << 20
NO_ID = -(1 << 63)
#: Pieces that each half of a worker's memory holds; the older half makes room.
MEMORY = 400_000
#: A row per image; ``inner`` counts the ids of the range's images before it.
IMAGES = "bucket int, image long, inner long, n_docs long, n_ids long, data binary"


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def word_of(bits: int) -> np.dtype:
    """The machine word that carries ids between tasks."""
    return np.dtype("<u2" if bits <= 16 else "<u4")


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shift = np.arange(bits, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shift) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack_block(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def pack_image(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """One file image; fails if an id needs more than ``bits`` bits."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    blocks = [pack_block(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    places = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids), len(blocks))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), starts.tobytes(), places.tobytes(), *blocks])


class Image:
    """Reader of one image; ``ids(a, b)`` unpacks only the blocks that hold the range."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.bits, self.block, docs, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        self.places = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * (docs + 1)).astype(np.int64)
        self.payload = at + 8 * (blocks + 1)

    def ids(self, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        n = min(self.n_ids, (last + 1) * self.block) - first * self.block
        if self.block * self.bits % 8 == 0:
            out = unpack_block(self.data[self.payload + self.places[first] : self.payload + self.places[last + 1]], n, self.bits)
        else:
            parts = [unpack_block(self.data[self.payload + self.places[b] : self.payload + self.places[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
            out = np.concatenate(parts)
        return out[begin - first * self.block : end - first * self.block]


class WordTokenizer:
    """The ``tokenizers`` library with a memory of the ids of white-space-delimited pieces.

    Only for files whose pretokenizer drops white space: then a text's ids are those of its pieces in order. A piece of
    ASCII letters with one full stop or comma is looked up as the two pretokens that it consists of, and ASCII letters in
    lower case where the file's normalizer does the same.
    """

    def __init__(self, path: str):
        # one core is one task's share; the library would start a thread for each core of the machine
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"

    def _learn(self, pieces: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        self.memory.update((p, np.asarray(e.ids, np.uint32).tobytes()) for p, e in zip(pieces, found, strict=True))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        if len(self.memory) > MEMORY:
            self.older, self.memory = self.memory, {}
        memory = self.memory
        if self.lowers:
            pieces = [p.lower() if p.isascii() and "<" not in p else p for p in pieces]
        parts = [(p[:-1], p[-1]) if p[-1:] in ".," and p.isascii() and p[:-1].isalpha() else (p,) for p in pieces]
        if unknown := {w for ws in parts for w in ws if w not in memory}:
            memory.update((w, self.older[w]) for w in unknown & self.older.keys())
            if unknown := [w for w in unknown if w not in memory]:
                self._learn(unknown)
        return [memory[ws[0]] if len(ws) == 1 else memory[ws[0]] + memory[ws[1]] for ws in parts]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; each distinct piece of the batch is looked up once. Null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        at = np.asarray(split.offsets).astype(np.int64)
        coded = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        made = self.pieces(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        blob = np.frombuffer(b"".join(made), np.uint32)
        n = size[codes]
        total = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        start = (np.cumsum(size) - size)[codes]
        return total[at - at[0]], blob[np.arange(total[-1]) + np.repeat(start - total[:-1], n)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def packed_documents(df: DataFrame, vocab_path: str, end_id: int, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, packed): the ids of each whole text and the end id, as little-endian words of ``word_of``. Narrow."""
    word = word_of(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocab_path).encode_batch
        end = word.type(end_id).tobytes()
        for batch in batches:
            offsets, ids = encode(batch.column(1))
            data, at = ids.astype(word).tobytes(), (offsets * word.itemsize).tolist()
            packed = [data[a:b] + end for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, packed binary")


def write_token_files(df: DataFrame, path: str, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, image_ids: int = IMAGE_IDS) -> None:
    """Tokenise every text and write images of at most ``image_ids`` ids (or one document) in ascending id order.

    Each range of document ids is one task; ids are encoded before they move, so text is not shuffled. Null text counts
    as empty (only the end id); null ids come last; rows that repeat an id follow one another in the order of their ids.
    An empty table writes an empty set of images. Other columns are ignored.
    """
    bits = bits_for(max(tokenizer(vocab_path).vocab_size, end_id + 1))
    parts = shuffle_partitions(df.sparkSession)
    ids = df.select(F.col(id_col).cast("long").alias("doc_id"))
    bucket = range_bucket(ids, "doc_id", parts)
    rows = packed_documents(df, vocab_path, end_id, bits, id_col, text_col).withColumn("bucket", bucket)
    rows = placed(rows, parts).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        state = {"bucket": None, "image": 0, "n": 0, "inner": 0}
        word = word_of(bits)

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) // word.itemsize for _, p in held], np.int64)
            data = pack_image(np.array([i for i, _ in held], np.int64), lengths, np.frombuffer(b"".join(p for _, p in held), word), bits, block)
            row = {"bucket": [state["bucket"]], "image": [state["image"]], "inner": [state["inner"]], "n_docs": [len(held)], "n_ids": [int(lengths.sum())], "data": [data]}
            held.clear()
            state.update(image=state["image"] + 1, n=0, inner=state["inner"] + int(lengths.sum()))
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("bucket", pa.int32()), ("image", pa.int64()), ("inner", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            for doc, packed, bucket_no in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (bucket_no != state["bucket"] or state["n"] + len(packed) // word.itemsize > image_ids):
                    yield flush()
                if bucket_no != state["bucket"]:
                    state.update(bucket=bucket_no, image=0, inner=0)
                held.append((NO_ID if doc is None else doc, packed))
                state["n"] += len(packed) // word.itemsize
        if held:
            yield flush()

    rows.mapInArrow(trimmed(run), IMAGES).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the images below ``path``: ``doc_id, start, ids`` (binary, 32-bit little-endian words).

    ``start`` counts the ids of all documents before it. The sizes of the ranges, one row per write task, are scanned and
    broadcast; images stay where they are read.
    """
    images = spark.read.schema(IMAGES).parquet(path)
    ranges = images.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    ranges = ranges.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    based = images.join(F.broadcast(ranges), "bucket").select((F.col("base") + F.col("inner")).alias("start"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = Image(data)
                # by block offsets: documents of about READ_IDS ids at a time, of which only their blocks are unpacked
                steps = np.unique(np.append(np.searchsorted(image.starts, np.arange(0, image.n_ids, READ_IDS)), len(image.doc_ids)))
                for first, last in zip(np.append(0, steps[steps > 0]).tolist(), steps[steps > 0].tolist(), strict=False):
                    cuts = image.starts[first : last + 1]
                    ids = image.ids(int(cuts[0]), int(cuts[-1])).astype("<u4").tobytes()
                    at = (4 * (cuts - cuts[0])).tolist()
                    own = image.doc_ids[first:last]
                    columns = [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(base + cuts[:-1], pa.int64()), pa.array([ids[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids"])

    return based.mapInArrow(trimmed(run), "doc_id long, start long, ids binary")


