"""Matching of column and table names against keywords."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

SUBSTRING, TOKEN = "substring", "token"


def tokens(name: str) -> list[str]:
    """``tripDuration_min`` -> ``['trip', 'duration', 'min']``."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return [t for t in re.split(r"[^a-z0-9]+", spaced.lower()) if t]


def name_has(name: str, keywords: Iterable[str], match: str = SUBSTRING) -> bool:
    """Whether a name known on the driver (a schema field) contains one of the keywords."""
    if match == SUBSTRING:
        return any(k in name.lower() for k in keywords)
    return bool(set(tokens(name)) & {k.lower() for k in keywords})


def column_has(c: Column, keywords: Iterable[str], match: str = SUBSTRING) -> Column:
    """The same test for names held in a column: one regular expression for the whole keyword list."""
    words = "|".join(re.escape(k.lower()) for k in keywords)
    if not words:
        return F.lit(False)
    if match == SUBSTRING:
        return F.lower(c).rlike(words)
    spaced = F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"))
    return spaced.rlike(f"(^|[^a-z0-9])({words})([^a-z0-9]|$)")
