"""Scalar functions on names, ids and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filesystem_safe(name: Column) -> Column:
    """Slashes to underscores, colons to hyphens, other unfit characters removed, outer dots and blanks cut."""
    out = F.regexp_replace(F.translate(name, "/\\:", "__-"), r"[*?\"<>|]", "")
    return F.regexp_replace(out, r"^[. ]+|[. ]+$", "")


def safe_publisher(name: Column) -> Column:
    return F.regexp_replace(name, r"[<>:\"/\\|?*]", "_")


def safe_title(title: Column, more: str = "") -> Column:
    """Letters, digits and blanks (and `more`) kept, blanks at the end cut."""
    return F.regexp_replace(F.regexp_replace(title, rf"[^\p{{L}}\p{{N}} {more}]", ""), r" +$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def column_name(name: str) -> str:
    """A model's name as a column name."""
    return name.replace("/", "_").replace(":", "_")


def escape_commas(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("⟨,⟩"))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """All entities decoded; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def clean_annotation_text(text: Column) -> Column:
    """Entities decoded, tags dropped, a blank after punctuation or digits before a letter and where a
    small letter meets a capital one, white space collapsed. Null is the empty text."""
    out = F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), r"<[^>]+>", "")
    out = F.regexp_replace(out, r"([.!?\p{Nd},:;])([a-zA-Z])", "$1 $2")
    out = F.regexp_replace(out, r"([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def numeric_or_null(value: Column) -> Column:
    return value.try_cast("double")
