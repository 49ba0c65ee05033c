"""Content digests, stable ids and 64-bit code arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(columns: dict[str, Column]) -> Column:
    """SHA-256 of the JSON object of the named values, keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), 256)


def stable_id(prefix: str, *values: Column) -> Column:
    digest = F.sha2(F.to_json(F.array(*[v.cast("string") for v in values])), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, 20))


def git_blob_sha(content: Column) -> Column:
    size = F.octet_length(content).cast("string")
    head = F.concat(F.encode(F.lit("blob "), "UTF-8"), F.encode(size, "UTF-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit patterns (negative longs included)."""
    return F.bit_count(a.bitwiseXOR(b))


def rotate_left(code: Column, by: int, bits: int) -> Column:
    """Rotate the low ``bits`` bits of ``code``."""
    by %= bits
    if by == 0:
        return code
    turned = F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, bits - by))
    if bits == 64:
        return turned
    return turned.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def hash_unit(*parts: Column) -> Column:
    """Uniform number in [0,1) from the first 32 bits of an MD5, equal in every engine."""
    text = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_pick(n: Column, *parts: Column) -> Column:
    """Integer in [0,n) from the first 32 bits of an MD5."""
    text = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), n)
