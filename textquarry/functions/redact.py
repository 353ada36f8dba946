"""Access-log expressions: redaction, client address and body preview."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .basics import ColumnOrName, col
from .text import strip


def redact_headers(headers: ColumnOrName) -> Column:
    return F.transform_values(
        col(headers),
        lambda k, v: F.when(F.lower(k).isin(*fixed.SENSITIVE_HEADERS), fixed.REDACTED).otherwise(v),
    )


def redact_query(path: ColumnOrName) -> Column:
    """Drop everything behind the first question mark."""
    p = col(path)
    return F.when(
        F.contains(p, F.lit("?")),
        F.concat(F.substring_index(p, "?", 1), F.lit("?" + fixed.REDACTED)),
    ).otherwise(p)


def client_ip(headers: ColumnOrName, peer: ColumnOrName) -> Column:
    """First forwarded address, else the peer's."""
    forwarded = col(headers)["x-forwarded-for"]
    return F.when(
        F.length(forwarded) > 0, strip(F.split(forwarded, ",")[0])
    ).otherwise(col(peer))


def body_preview(body: ColumnOrName, cut_before: ColumnOrName | None = None) -> Column:
    """The first characters of a body, marked when cut here or before (streamed)."""
    b = col(body)
    cut = F.lit(False) if cut_before is None else F.coalesce(col(cut_before), F.lit(False))
    return (
        F.when(
            F.length(b) > fixed.PREVIEW_CHARS,
            F.concat(F.left(b, F.lit(fixed.PREVIEW_CHARS)), F.lit(fixed.PREVIEW_MARK)),
        )
        .when(cut & (F.length(b) > 0), F.concat(b, F.lit(fixed.PREVIEW_MARK)))
        .otherwise(b)
    )
