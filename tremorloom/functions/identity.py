"""Content identities, JSON and string normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
LOCALES = ("en", "es", "ja")


def sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def key_sha256(*columns: Column) -> Column:
    """Hash of a key's parts joined by line breaks."""
    return F.sha2(F.concat_ws("\n", *[c.cast("string") for c in columns]), 256)


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and no blanks."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def email(column: Column, longest: int = 254) -> Column:
    """Trimmed, lower-case address, null where it is none."""
    bare = F.lower(F.trim(column))
    return F.when((F.length(bare) <= longest) & bare.rlike(EMAIL), bare)


def locale(column: Column) -> Column:
    short = F.substring(F.lower(F.coalesce(column, F.lit(""))), 1, 2)
    return F.when(short.isin(*LOCALES), short).otherwise(LOCALES[0])


def event_identity(source_id: Column, legacy_id: Column, number: Column) -> Column:
    """The first identity that is there, with the name of its scheme."""
    return F.coalesce(F.concat(F.lit("source:"), source_id), F.concat(F.lit("legacy:"), legacy_id), F.concat(F.lit("row:"), number.cast("string")))
