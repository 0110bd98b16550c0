"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Encoding. A pretoken is cut into longest vocabulary matches found by an Aho-Corasick automaton. A match is kept if it may
stand beside its predecessor in a merged sequence (the pair-compatibility table); else the next shorter prefix is tried,
and when none is left the predecessor is taken back. A bit per position marks dead ends, so that each position is tried
once per token and time stays linear. The result equals that of applying the merges in their order.

Decoding. All token bytes lie in one blob; an id selects ``blob[offset[id]:offset[id + 1]]``, gathered for a whole batch
by numpy.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trimmed

#: Pieces, and pairs of tokens, that each half of a worker's memory holds; the older half makes room. No result depends on it.
MEMORY = 100_000
PAIRS = 200_000
#: The split rule of byte-level vocabularies, and the end of the letters for which it is applied here directly.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LATIN = "\u0250"
BORDER = regex.compile(r"(?<=\S)(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class OffsetTable:
    """Decoder of one byte-level vocabulary file in the ``tokenizers`` JSON form."""

    def __init__(self, spec: dict):
        vocab, special, alphabet = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}, byte_alphabet()
        spelled: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in vocab.items():
            spelled[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        for t, i in special.items():
            spelled[i] = t.encode()
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        start = self.offsets[ids]
        n = self.offsets[ids + 1] - start
        total = np.cumsum(n)
        if not len(total) or not total[-1]:
            return b""
        index = np.arange(total[-1]) + np.repeat(start - (total - n), n)
        return self.blob[index].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class BytePairCodec:
    """Encoder of one byte-level vocabulary file in the ``tokenizers`` JSON form."""

    def __init__(self, spec: dict):
        import ahocorasick
        from tokenizers.pre_tokenizers import ByteLevel

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level vocabulary")
        self.pretokens = ByteLevel(add_prefix_space=False, use_regex=split.get("use_regex", True)).pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = byte_alphabet()
        # internal numbers follow merge order: bytes first, then one for each merge
        self.number: dict[str, int] = {c: i for i, c in enumerate(self.alphabet)}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(self.number))]
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in merges:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (self.number[a], self.number[b])
            made = self.number.setdefault(a + b, len(self.parts))
            if made == len(self.parts):
                self.parts.append(pair)
            self.pairs.setdefault(pair, made)
        names = list(self.number)
        self.ids = [vocab[t] for t in names]
        self.length = [len(t) for t in names]
        self.shorter = [next((self.number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.number), -1) for t in names]
        self.automaton = ahocorasick.Automaton()
        for t, n in self.number.items():
            self.automaton.add_word(t, n)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}  # by left << 32 | right
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spelling = {b: c for c, b in self.alphabet.items()}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging keeps ``left`` and ``right`` apart: no earlier merge joins pieces across their border."""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        limit = len(self.parts)
        while True:
            made = self.pairs.get((left, right))
            if made is not None and made < limit:
                return False
            # undo the later of the two merges that touch the border
            if left > right:
                limit, inner = left, self.parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, self.parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, self.parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, self.parts[left][1]
                if inner == left:
                    return True
                left = inner

    def encode_pretoken(self, spelled: str) -> list[int]:
        length, shorter, compatible, ids = self.length, self.shorter, self.compatible, self.ids
        greedy = [n for _, n in self.automaton.iter_long(spelled)]
        left = -1
        for right in greedy:  # where longest matches are all compatible, nothing is ever taken back
            if left >= 0 and not compatible.get(left << 32 | right) and not self.may_follow(left, right):
                break
            left = right
        else:
            return [ids[n] for n in greedy]
        longest = [-1] * len(spelled)
        for end, n in self.automaton.iter(spelled):  # matches that end here come longest first
            start = end - length[n] + 1
            if longest[start] < 0 or length[n] > length[longest[start]]:
                longest[start] = n
        token, last = longest[0] if spelled else -1, len(spelled)
        alive = bytearray(b"\x01") * (last + 1)
        out: list[int] = []
        at = 0
        while token >= 0:
            end = at + length[token]
            if alive[end] and (not out or compatible.get(out[-1] << 32 | token) or self.may_follow(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < last else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return [ids[n] for n in out]

    def _spell(self, token: str) -> str:
        if token.isascii() and token.isprintable():
            return token.replace(" ", self.spelling[32])
        return token.encode().decode("latin-1").translate(self.spelling)

    def _keep(self, piece: str, made: bytes) -> bytes:
        if len(piece) <= 64:  # longer ones seldom come again
            if len(self.memory) >= MEMORY:
                self.older, self.memory = self.memory, {}
            self.memory[piece] = made
        return made

    def _token(self, token: str) -> bytes:
        return self._keep(token, self.older.get(token) or array("i", self.encode_pretoken(self._spell(token))).tobytes())

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece, remembered. Unicode versions agree on Latin letters, so those are split here directly."""
        if made := self.older.get(piece):
            return self._keep(piece, made)
        if max(piece) < LATIN:
            tokens = PRETOKEN.findall(piece)
            if len(tokens) == 1:
                return self._token(piece)
            made = b"".join([self.memory.get(t) or self._token(t) for t in tokens])
        else:
            made = b"".join([array("i", self.encode_pretoken(spelled)).tobytes() for spelled, _ in self.pretokens(piece)])
        return self._keep(piece, made)

    def _plain(self, text: str) -> bytes:
        """Text without special tokens: cut before a single space between characters that are not white space.

        A pretoken never spans such a border, so the pieces are looked up one by one.
        """
        return b"".join([self.memory.get(p) or self._piece(p) for p in BORDER.split(text) if p])

    def encode(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        while text:
            cuts = [(text.find(s), -len(s), s) for s in self.special if s in text]
            if not cuts:
                parts.append(self._plain(text))
                break
            at, _, name = min(cuts)
            parts.append(self._plain(text[:at]))
            parts.append(np.int32(self.special[name]).tobytes())
            text = text[at + len(name) :]
        return np.frombuffer(b"".join(parts), np.int32)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; every distinct piece of the batch is looked up once.

        Where a text has no two spaces in a row, each space begins a piece; the few others, and those that spell a
        special token, are encoded alone and stand in as one piece.
        """
        texts = pc.fill_null(texts, "")
        alone = pc.match_substring(texts, "  ")
        for name in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, name))
        alone = np.flatnonzero(alone.to_numpy(zero_copy_only=False))
        if len(alone):
            mask = np.zeros(len(texts), bool)
            mask[alone] = True
            split = pc.split_pattern(pc.if_else(pa.array(mask), "", texts), " ")
        else:
            split = pc.split_pattern(texts, " ")
        offsets = np.asarray(split.offsets)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = offsets[:-1] - offsets[0]
        made = [self.memory.get(p) or self._piece(p) for p in [" " + w for w in coded.dictionary.to_pylist()]]
        known = len(made)
        heads = pc.take(coded.dictionary, pa.array(codes[first])).to_pylist()
        made += [(self.memory.get(w) or self._piece(w)) if w else b"" for w in heads]
        for i in alone:
            made[known + i] = self.encode(texts[int(i)].as_py()).tobytes()
        codes[first] = known + np.arange(len(texts))
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        blob = np.frombuffer(b"".join(made), np.int32)
        start = np.cumsum(size) - size
        n = size[codes]
        total = np.cumsum(n)
        count = int(total[-1]) if len(total) else 0
        flat = blob[np.arange(count) + np.repeat(start[codes] - (total - n), n)]
        begins = np.concatenate([[0], total])[np.concatenate([first, [len(codes)]])]
        return begins.astype(np.int32), flat


_encoders: dict[str, BytePairCodec] = {}
_decoders: dict[str, OffsetTable] = {}


def _load(path: str, kind: type, known: dict):
    if path not in known:
        with open(path, encoding="utf-8") as f:
            known[path] = kind(json.load(f))
    return known[path]


def codec(path: str) -> BytePairCodec:
    """One encoder per worker process and file."""
    return _load(path, BytePairCodec, _encoders)


def offset_table(path: str) -> OffsetTable:
    """One decoder per worker process and file; it needs no merges and no automaton."""
    return _load(path, OffsetTable, _decoders)


def _added(df: DataFrame, columns: dict[str, T.DataType], drop: Collection[str]) -> tuple[list[str], T.StructType]:
    """(kept columns, schema) with the new columns last; columns of their names, in any case, make room."""
    gone = {c.lower() for c in (*columns, *drop)}
    kept = [c for c in df.columns if c.lower() not in gone]
    return kept, T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, t) for c, t in columns.items())])


def _extended(batch: pa.RecordBatch, kept: int, values: list[pa.Array], schema: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:kept], *values], names=schema)


def _decoded(table: OffsetTable, lists: pa.ListArray) -> pa.Array:
    return pa.array([table.decode(np.asarray(x.values)) if x.is_valid and len(x.values) else "" for x in lists], pa.string())


IDS = T.ArrayType(T.IntegerType())


def bpe_encode(df: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None, drop: Collection[str] = ()) -> DataFrame:
    """Adds ``out_col`` (array of int): the ids of the whole text, without special tokens of its own.

    With ``decoded_col``, what the ids decode to is added by the same worker. A special token's string inside a text
    becomes its id. Null and empty texts have no ids (an empty array); a very long text is encoded whole, in memory that
    grows with that text alone. All other columns pass through, but for those in ``drop``; a column of a new one's name
    is replaced. Repeated rows and null ids pass through as they are. An empty table gives an empty result. A narrow
    operator: rows neither move nor repeat.
    """
    new = {out_col: IDS} | ({decoded_col: T.StringType()} if decoded_col else {})
    kept, schema = _added(df, new, drop)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocab_path).encode_batch
        for batch in batches:
            offsets, flat = encode(batch.column(len(kept)))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            values = [ids, _decoded(offset_table(vocab_path), ids)] if decoded_col else [ids]
            yield _extended(batch, len(kept), values, names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(trimmed(run), schema)


def bpe_decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the text of the ids, special tokens spelled out; bytes that are not UTF-8 become U+FFFD.

    Null and empty arrays decode to the empty string. An id outside the vocabulary fails the job. Columns as above.
    """
    kept, schema = _added(df, {out_col: T.StringType()}, ())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = offset_table(vocab_path)
        for batch in batches:
            yield _extended(batch, len(kept), [_decoded(table, batch.column(len(kept)))], names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").cast(IDS).alias("__ids")).mapInArrow(trimmed(run), schema)


def ids_digest(ids: F.Column) -> F.Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
