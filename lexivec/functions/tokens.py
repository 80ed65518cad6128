"""Token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, marks and digits of any script, in order."""
    parts = F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"[^\p{L}\p{M}\p{N}]+")
    return F.filter(parts, lambda t: t != "")
