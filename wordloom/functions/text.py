"""Text and label expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.settings import NA_STRINGS, PAD_IDX, TOKEN_PATTERN


def decode_missing(col: Column) -> Column:
    """NULL for every spelling that counts as missing."""
    return F.when(~col.isin(NA_STRINGS), col)


def label_from_class_index(col: Column) -> Column:
    """Zero-based label of a one-based class index; '4.0' counts as 4, missing is an error."""
    value = decode_missing(F.trim(col))
    return F.when(
        value.isNull(), F.raise_error(F.lit("class index is missing")).cast("int")
    ).otherwise(value.cast("double").cast("int") - 1)


def document_text(title: Column, description: Column) -> Column:
    """Both parts joined by exactly one space; a missing part counts as empty."""
    blank = F.lit("")
    return F.concat(F.coalesce(title, blank), F.lit(" "), F.coalesce(description, blank))


def label_name(label: Column, names: Sequence[str]) -> Column:
    """Name at position `label`; NULL for an unknown id."""
    return F.get(F.array(*[F.lit(n) for n in names]), label.cast("int"))


def tokens(text: Column, lower: bool = True) -> Column:
    """All tokens of `text` in order."""
    source = F.lower(text) if lower else text
    return F.regexp_extract_all(source, F.lit(TOKEN_PATTERN), F.lit(0))


def pad_or_cut(ids: Column, max_len: int) -> Column:
    """First `max_len` ids, filled up on the right with the pad id."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD_IDX), max_len)), 1, max_len)


def real_positions(ids: Column) -> Column:
    """Padding mask: true where the id is not the pad id."""
    return F.transform(ids, lambda i: i != PAD_IDX)
