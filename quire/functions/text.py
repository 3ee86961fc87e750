"""Text column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token of the byte-level tokenizer is one byte of the UTF-8 text.
WINDOWS = (4096, 8192, 32768, 128000)


def byte_tokens(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def source_key(source: Column) -> Column:
    """A site name without outer blanks, in lower case; null stays null."""
    return F.lower(F.trim(source))


def unicode_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def label_key(label: Column) -> Column:
    """A label as spelled in label_set: lower case, no outer blanks, '-' for '_' and inner blanks."""
    return F.regexp_replace(F.lower(unicode_strip(label)), r"(?U)[_\s]+", "-")
