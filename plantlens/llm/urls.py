"""URL parts as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: str = "url") -> Column:
    """What follows the first ``://``; empty when there is none, or for null."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")


def host(url: str = "url") -> Column:
    """Up to the first ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)
