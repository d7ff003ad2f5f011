"""Keyed digests and signed cursors as expressions: a place in an order that only who has the secret can make."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a cursor's signature.
SIGNATURE = 32


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in lower-case hexadecimal digits, by the definition: a digest over the key and a digest."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _signature(secret: bytes, bound: Column, place: Column) -> Column:
    return F.substring(hmac_sha256(secret, F.concat_ws("\n", bound, place)), 1, SIGNATURE)


def signed_cursor(secret: bytes, bound: Column, place: Column) -> Column:
    """A cursor to a place, signed together with what it is bound to; null for a null place."""
    text = place.cast("string")
    return F.when(place.isNotNull(), F.base64(F.concat(text, F.lit("."), _signature(secret, bound, text)).cast("binary")))


def cursor_place(secret: bytes, bound: Column, cursor: Column) -> Column:
    """The place of a cursor; null if it was not made with this secret for what it is bound to."""
    text = F.try_to_binary(cursor, F.lit("base64")).cast("string")
    place, given = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    return F.when(F.regexp_like(text, F.lit(r"^-?\d{1,18}\.[0-9a-f]+$")) & (given == _signature(secret, bound, place)), place.cast("long"))
