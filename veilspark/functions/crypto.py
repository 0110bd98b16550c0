"""Keyed functions from built-in SHA-256: HMAC, placeholders, fingerprints, uniform numbers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For tests and benchmarks only; give a key of your own in production.
TEST_KEY = b"veilspark test key"
#: Letters of a placeholder body: 14 of 16 letters are 56 bits.
LETTERS = 14


def pads(key: bytes) -> tuple[bytes, bytes]:
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(message: Column, key: bytes = TEST_KEY) -> Column:
    """HMAC-SHA-256 of a binary column, in lower-case hex."""
    inner, outer = pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


ZERO = b"\0"


def fingerprint(type_: Column, value: Column) -> Column:
    """SHA-256 of type, a zero byte and value. Internal: short values can be guessed from it."""
    return F.sha2(F.concat(_bytes(type_), F.lit(ZERO), _bytes(value)), 256)


def placeholder(session: Column, type_: Column, value: Column, key: bytes = TEST_KEY, letters: int = LETTERS) -> Column:
    """The session's placeholder of a value: equal values share it, other sessions differ; letters only."""
    if not 8 <= letters <= 32:
        raise ValueError("a placeholder has 8 to 32 letters")
    digest = hmac_hex(F.concat(_bytes(session), F.lit(ZERO), _bytes(type_), F.lit(ZERO), _bytes(value)), key)
    body = F.substring(F.translate(F.upper(digest), "0123456789ABCDEF", "ABCDEFGHIJKLMNOP"), 1, letters)
    return F.concat(F.lit("["), type_, F.lit("_"), body, F.lit("]"))


def uniform(message: Column, key: bytes = TEST_KEY) -> Column:
    """A number in the open interval (-0.5, 0.5) from 52 bits of the keyed digest."""
    bits = F.conv(F.substring(hmac_hex(_bytes(message), key), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(2.0**52) - F.lit(0.5)


def prompt_fingerprint(text: Column, key: bytes = TEST_KEY) -> Column:
    """HMAC of a prompt; the empty string for null."""
    return F.when(text.isNull(), F.lit("")).otherwise(hmac_hex(_bytes(text), key))
