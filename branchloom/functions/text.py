"""Attribute strings, identifier lists and tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_ids(text: Column) -> Column:
    """Trimmed, unquoted, non-empty parts of a list split at ; and , ."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    return F.filter(parts, lambda x: ~F.lower(x).isin("", ".", "na"))


def attribute(text: Column, name: str) -> Column:
    """Value of one key of ``k=v;k=v``; of repeated keys the last one."""
    hits = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.lower(F.trim(F.substring_index(x, "=", 1))) == name.lower())
    return F.when(F.size(hits) > 0, F.trim(F.substring_index(F.element_at(hits, -1), "=", -1)))


def format_attributes(text: Column) -> Column:
    """Parts of ``k=v;`` trimmed, distinct and sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))), ";")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of letters and digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))))


def element_id(homology: Column) -> Column:
    """Public id of a homology id (in lower case): EG_ and what follows its prefix hc_, hsg_ or h_, else all of it."""
    return F.concat(F.lit("EG_"), F.regexp_replace(homology, "^(?:hc|hsg|h)_", ""))


def url_id(*parts: Column) -> Column:
    """Path of URL-encoded parts; blanks as %20."""
    return F.concat_ws("/", *[F.regexp_replace(F.url_encode(p), r"\+", "%20") for p in parts])
