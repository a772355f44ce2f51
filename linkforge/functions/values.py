"""Numbers, hashes, dates and JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from linkforge.functions.text import clean_text, text_of


def year_text(c: Column) -> Column:
    """The first 19dd or 20dd in a text; ''."""
    return F.regexp_extract(text_of(c.cast("string")), r"(?:19|20)\d{2}", 0)


def as_int(c: Column) -> Column:
    """A whole number or NULL."""
    return F.trim(c.cast("string")).try_cast("bigint")


def sha256_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def record_id(c: Column) -> Column:
    """The first 16 hex digits of the hash."""
    return F.left(sha256_hex(c), F.lit(16))


def content_hash(*cols: Column) -> Column:
    """Hash of a row as JSON; NULL fields are left out, the order of columns counts."""
    return sha256_hex(F.to_json(F.struct(*cols)))


def utc_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")


def json_object(c: Column, schema: str, strict: bool = False) -> Column:
    """A JSON object by schema; texts that are no object give NULL, or fail when strict."""
    return F.from_json(c, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def completeness(cols: list[Column]) -> Column:
    """Share of columns that are neither NULL nor blank nor an empty array's text, to two decimals."""
    full = sum((F.when(text_of(c.cast("string")).isin("", "[]"), 0).otherwise(1) for c in cols), F.lit(0))
    return F.bround(full / F.lit(len(cols)), 2)


def relevance(priority: Column, identifiers: Column) -> Column:
    """Score of a source: ten for each step of priority, five for each matching identifier."""
    return (10 - priority) * 10 + F.size(identifiers) * 5


def search_key(provider: Column, query: Column, limit: Column, settings: Column) -> Column:
    """Cache key of a search."""
    return sha256_hex(F.to_json(F.struct(provider.alias("provider"), F.lower(clean_text(query)).alias("query"), limit.alias("limit"), settings.alias("settings"))))
