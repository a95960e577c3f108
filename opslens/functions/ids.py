"""Identity, tenancy and severity columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TENANT = "default"
HIGH_SCORE = 5.0


def name_uuid(raw: Column) -> Column:
    """Version-3 (MD5, name-based) UUID of binary input."""
    h = F.md5(raw)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.pmod(nibble, F.lit(4)) + 1)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"),
        F.substring(h, 9, 4), F.lit("-3"),
        F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )


def incident_id(fp: Column, kind: Column) -> Column:
    """Same fingerprint and anomaly type, same incident, whatever the row order."""
    return name_uuid(F.unhex(F.sha2(F.concat(fp, F.lit(":"), kind), 256)))


def severity(score: Column, high: str = "HIGH", low: str = "MEDIUM") -> Column:
    return F.when(score > HIGH_SCORE, F.lit(high)).otherwise(F.lit(low))


def resolve_tenant(meta: Column, default: str = DEFAULT_TENANT) -> Column:
    """``tenantId`` of an open map, else the default tenant."""
    return F.coalesce(F.try_element_at(meta, F.lit("tenantId")), F.lit(default))


def resolve_trace(ctx: Column, entry: Column) -> Column:
    """Request trace, then the entry's own, then a fresh id."""
    blank = F.lit("")
    return F.coalesce(F.nullif(ctx, blank), F.nullif(entry, blank), F.uuid())
