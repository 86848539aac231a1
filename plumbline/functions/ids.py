"""Ids derived from texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """HSH-02: a prefix and the first hex digits of the SHA-256 of the parts joined by |."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def name_uuid(namespace: uuid.UUID, name: Column) -> Column:
    """HSH-03: the version-5 UUID of a name."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def lock_key(text: Column) -> Column:
    """HSH-04: the first 8 bytes of the SHA-256 as a number of 63 bits."""
    digits = F.sha2(text, 256)
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint") % (1 << 31)
    return F.shiftleft(high, 32) + F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")


def artefact_path(content: Column) -> Column:
    """SNK-06: the first two hex digits of the content's SHA-256, and all of them below."""
    sha = F.sha2(content, 256)
    return F.concat(F.substring(sha, 1, 2), F.lit("/"), sha)
