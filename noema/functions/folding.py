"""Folding of letters by Unicode's rules. Spark has no built-in normal forms, so texts with anything beyond ASCII pass an
Arrow function; of all others only a null is sent, and their form is a built-in."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def identity_text(text: str) -> str:
    """Compatible characters made equal (NFKC), case-folded."""
    return unicodedata.normalize("NFKC", text).casefold()


def search_text(text: str) -> str:
    """Case-folded, compatible characters made equal (NFKD), without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def client_text(text: str) -> str:
    """Without marks (NFD), lowered."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()


def plain(text: str, fold: Callable[[str], str]) -> str:
    """A constant folded on the driver, white space collapsed."""
    return re.sub(r"\s+", " ", fold(text)).strip()


def _column(fold: Callable[[str], str]) -> Callable[[Column], Column]:
    def many(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else fold(x))

    many.__annotations__ = {"texts": pd.Series, "return": pd.Series}  # Spark reads the kind of function from these
    run = F.pandas_udf(many, StringType())

    def folded(text: Column) -> Column:
        odd = text.rlike(r"[^\x00-\x7F]")
        return F.when(odd, run(F.when(odd, text))).otherwise(F.lower(text))

    return folded


identity_fold, search_fold, client_fold = map(_column, (identity_text, search_text, client_text))


def each(texts: Column, fold: Callable[[Column], Column]) -> Column:
    """A fold of every text of an array, which a lambda can't call: as one text with NUL between. Nulls are left out."""
    folded = F.split(fold(F.array_join(texts, "\0")), "\0")
    return F.when(F.size(texts) > 0, folded).otherwise(F.when(texts.isNotNull(), F.array().cast("array<string>")))
