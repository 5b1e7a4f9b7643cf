"""Summaries of rows that show no large or binary values, and small text helpers for listings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import plain

LIMIT = 32


def value_summary(v: Column) -> Column:
    """NULL, the plain text, or only kind and length for binary, bit and long values."""
    text = plain(v)
    hidden = v["kind"].isin("binary", "bit") | (F.octet_length(text) > LIMIT)
    return F.when(v["is_null"], F.lit("NULL")).when(hidden, F.concat(F.lit("<"), v["kind"], F.lit(" len="), F.octet_length(text).cast("string"), F.lit(">"))).otherwise(text)


def text_summary(kind: str, text: Column) -> Column:
    """The same for a plain text column."""
    hidden = F.lit(kind in ("binary", "bit")) | (F.octet_length(text) > LIMIT)
    return F.when(text.isNull(), F.lit("NULL")).when(hidden, F.concat(F.lit(f"<{kind} len="), F.octet_length(text).cast("string"), F.lit(">"))).otherwise(text)


def row_summary(row: Column) -> Column:
    return F.array_join(F.transform(row, lambda x: F.concat(x["column"], F.lit("="), value_summary(x["value"]))), ", ")


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\S*)", 1)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def or_dash(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))
