"""Scalar text functions as column expressions. White space is the ASCII kind, so that results don't depend on the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEYS = ("secret", "token", "passwd", "password", "api_key")
_GAP, _QUOTED = "[ \\t\\n\\r\\f]*", "[\"'][^\"']{4,}[\"']"
_HIDDEN = '"<redacted>"'
#: (pattern, replacement) in order; $1 is the first group: assignments, entries of mappings, headers. Case is ignored.
CREDENTIALS = (
    (f"({'|'.join((*_KEYS, 'bearer'))}){_GAP}={_GAP}{_QUOTED}", f"$1 = {_HIDDEN}"),
    (f"({'|'.join(_KEYS)}){_GAP}:{_GAP}{_QUOTED}", f"$1: {_HIDDEN}"),
    (f"(basic|bearer|authorization){_GAP}[: \\t\\n\\r\\f]+{_GAP}[\"']?[a-zA-Z0-9_.=+/-]{{8,}}[\"']?", f"$1: {_HIDDEN}"),
)


def redacted(text: Column) -> Column:
    for pattern, new in CREDENTIALS:
        text = F.regexp_replace(text, "(?i)" + pattern, new)
    return text


def has_credential(text: Column) -> Column:
    """Whether a value is left that redaction would hide."""
    out = F.lit(False)
    for pattern, _ in CREDENTIALS:
        out = out | text.rlike("(?i)" + pattern)
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
