"""Normal forms, keys and identifiers of names, phones and addresses."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_text(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), F.lit(""))


def normal_phone(x: Column) -> Column:
    """Digits, the last ten."""
    return F.nullif(F.right(F.regexp_replace(x, r"[^0-9]", ""), F.lit(10)), F.lit(""))


def joined_address(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def identity_key(phone: Column, name: Column, address: Column, fallback: Column) -> Column:
    """phone, else name and address, else anonymous by the given stable fallback."""
    p, n, a = normal_phone(phone), normal_text(name), normal_text(address)
    return (
        F.when(p.isNotNull(), F.concat(F.lit("phone:"), F.sha2(p, 256)))
        .when(n.isNotNull() & a.isNotNull(), F.concat(F.lit("addr:"), F.sha2(F.concat_ws("|", n, a), 256)))
        .otherwise(F.concat(F.lit("anon:"), F.sha2(fallback.cast("string"), 256)))
    )


def uuid5(namespace: uuid.UUID, *parts: Column) -> Column:
    """RFC 4122 version 5 of the lower-case, trimmed parts joined by ':'."""
    name = F.concat_ws(":", *[F.lower(F.trim(p)) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.right(variant, F.lit(1)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def contains_ci(x: Column, needle: str) -> Column:
    """Case-insensitive contains; % and _ of the needle stay wildcards."""
    return F.upper(x.cast("string")).like(f"%{needle.upper()}%")
