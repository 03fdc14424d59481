"""Deterministic identifiers: version 5 UUIDs, date-anchored keys, version keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name, as the standard library gives it, without Python on the executors."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + F.lit(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def chunk_id(source: Column, index: Column, text: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Of a chunk: its source, place and text decide it, so that a second ingest changes nothing."""
    return uuid5(namespace, F.concat_ws("|", source, index.cast("string"), F.substring(F.sha2(text, 256), 1, 16)))


def dated_key(date: Column, *parts: Column) -> Column:
    """'date|part|part' with missing parts empty; null without a date."""
    return F.when(date.isNotNull(), F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def version_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)
