"""Folding over all of Unicode, for which Spark has no function: Arrow batches through Python's tables. Texts in Latin letters
are better folded by `text.fold_accents`, which stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _bare(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f"))


@F.pandas_udf(StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Every letter without its combining marks; null stays null."""
    return text.map(_bare, na_action="ignore")


@F.pandas_udf(StringType())
def search_folded(text: pd.Series) -> pd.Series:
    """Full-width and other compatibility forms made plain, marks removed, lower-cased."""
    return text.map(lambda t: _bare(unicodedata.normalize("NFKC", t)).lower(), na_action="ignore")
