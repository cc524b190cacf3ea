"""Signed session tokens as column expressions: base64url(JSON payload) "." base64url(HMAC-SHA256 of it)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a string or binary column as binary, from two built-in hashes; the secret is one value."""
    key = (hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret).ljust(BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(F.lit(outer), first), 256))


def base64url(value: Column) -> Column:
    return F.rtrim(F.translate(F.base64(value.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """Binary; null where the text is no base64."""
    padded = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    return F.when(text.rlike("^[A-Za-z0-9_-]*$") & (F.length(text) % 4 != 1), F.unbase64(padded))


def create_token(payload: Column, secret: bytes) -> Column:
    """A token of a JSON payload (text with exp, seconds since 1970)."""
    body = base64url(payload)
    return F.concat(body, F.lit("."), base64url(hmac_sha256(body, secret)))


def verify_token(token: Column, secret: bytes, now: Column) -> Column:
    """The JSON payload of a genuine token that has not expired, else null. Digests of both signatures are compared,
    so the time tells nothing about how much of one was right."""
    body, sign = F.substring_index(token, ".", 1), F.substring_index(token, ".", -1)
    shape = F.size(F.split(token, r"\.")) == 2
    genuine = F.sha2(sign.cast("binary"), 256) == F.sha2(base64url(hmac_sha256(body, secret)).cast("binary"), 256)
    payload = from_base64url(body).cast("string")
    alive = F.get_json_object(payload, "$.exp").cast("long") > now.cast("long")
    return F.when(F.coalesce(shape & genuine & alive, F.lit(False)), payload)
