"""String and normalization functions: Column in, Column out, inside whole-stage code generation where Spark allows.

Missing is NULL inside the engine; functions that must give text give ''. White space is Unicode white
space, as (?U) makes it in Java patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_in(text: Column, parts) -> Column:
    """Whether one of the literal ``parts`` is a substring."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Collapse runs of white space to a space and strip; NULL gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    """Stripped text, NULL where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_nonblank(*cols: Column) -> Column:
    """The first of ``cols`` with more than white space, stripped; NULL if none."""
    return F.coalesce(*[blank(c) for c in cols])


def first_present(*cols: Column) -> Column:
    """As ``first_nonblank``, with inner white space collapsed."""
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in cols])


def text_of(c: Column) -> Column:
    """NULL becomes ''."""
    return F.coalesce(c, F.lit(""))


def normalize_title(c: Column) -> Column:
    """The match key: lower case, runs of other than a-z and 0-9 to one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def source_slug(c: Column, fallback: str = "source", length: int = 80) -> Column:
    """A slug cut to ``length``, or ``fallback`` if there is none."""
    return F.coalesce(F.nullif(F.substring(slugify(c), 1, length), F.lit("")), F.lit(fallback))


def strip_tags(c: Column) -> Column:
    """Tags to spaces, white space collapsed; the text of scripts and styles stays."""
    return clean_text(F.regexp_replace(c, "<[^>]+>", " "))


def visible_text(c: Column) -> Column:
    """Text without tags and without what scripts, styles and noscript hold."""
    return strip_tags(F.regexp_replace(c, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "))


#: Cells that mean nothing.
LITERAL_NULLS = ("none", "null", "undefined", "nan", "-")


def clean_cell(c: Column) -> Column:
    """Stripped cell; literal nulls and NULL give ''."""
    text = strip(text_of(c))
    return F.when(F.lower(text).isin(*LITERAL_NULLS), F.lit("")).otherwise(text)


def pipe_join(*cols: Column) -> Column:
    """Pieces of all cells, split at | and ;, cleaned, distinct in order, joined by |. A cell that is a JSON
    array gives its items whole."""
    def pieces(c: Column) -> Column:
        cell = clean_cell(c)
        loaded = F.from_json(cell, "array<string>")
        is_list = cell.startswith("[") & cell.endswith("]") & loaded.isNotNull()
        return F.when(is_list, loaded).otherwise(F.split(cell, r"[|;]+"))

    every = F.transform(F.concat(*[pieces(c) for c in cols]), clean_cell)
    return F.array_join(F.array_distinct(F.filter(every, lambda x: x != "")), "|")


def joined(c: Column, sep: str = "; ") -> Column:
    """An array as one cell; NULL gives ''."""
    return text_of(F.array_join(c, sep))


def ordered_unique(c: Column, keep_blank: bool = True) -> Column:
    """Distinct items in order of first appearance, case-sensitive."""
    return F.array_distinct(c if keep_blank else F.filter(c, lambda x: x.isNotNull() & (x != "")))


def ordered_unique_ci(c: Column, keep_blank: bool = True) -> Column:
    """Distinct items in order of first appearance, compared in lower case. One fold: the items are computed once."""
    items = c if keep_blank else F.filter(c, lambda x: x.isNotNull() & (x != ""))
    add = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(items, F.array().cast("array<string>"), add)


def tokens(c: Column) -> Column:
    """Distinct tokens of the match key."""
    return F.array_distinct(F.array_remove(F.split(normalize_title(text_of(c)), " "), ""))


def jaccard_of(a: Column, b: Column) -> Column:
    """Similarity of two token sets: both empty 1, one empty 0."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def similarity(a: Column, b: Column) -> Column:
    return jaccard_of(tokens(a), tokens(b))


def artist_key(c: Column) -> Column:
    return normalize_title(F.regexp_replace(text_of(c), r"(?iu)^(by|artists?):(?U)\s*", ""))


def artist_similarity(a: Column, b: Column) -> Column:
    return similarity(artist_key(a), artist_key(b))


def artist_names(c: Column) -> Column:
    """Names of a credit line, split at 'and', '&' and commas, without a leading 'by' or 'artist:'."""
    plain = F.regexp_replace(text_of(c), r"(?iu)^(by|artists?:)(?U)\s+", "")
    return F.filter(F.transform(F.split(plain, r"(?U)\s+(?:and|&)\s+|,\s*"), strip), lambda x: x != "")


def strip_site_suffix(c: Column) -> Column:
    """What stands before the first ' | ' or ' - '."""
    return F.when(text_of(c) != "", clean_text(F.element_at(F.split(c, r"(?U)\s+[|]\s+|\s+-\s+", 2), 1)))


def near_contains(haystack: Column, needle: Column) -> Column:
    """Whether the needle's key is in the haystack's, or all but one of its words over two letters (two at least)."""
    key = normalize_title(text_of(needle))
    hay = F.regexp_replace(F.lower(text_of(haystack)), "[^a-z0-9]+", " ")
    long_words = F.filter(F.split(key, " "), lambda w: F.length(w) > 2)
    found = F.size(F.filter(long_words, lambda w: F.contains(hay, w)))
    loose = (F.size(long_words) > 1) & (found >= F.greatest(F.lit(2), F.size(long_words) - 1))
    return (text_of(needle) != "") & (((key != "") & F.contains(hay, key)) | loose)


def sentences(c: Column) -> Column:
    return F.split(clean_text(c), r"(?<=[.!?])(?U)\s+")


#: What marks a sentence as evidence of how something was made.
EVIDENCE = r"(?iu)\b(materials?|made from|made of|made with|fabricat|constructed|built)\b"
MATERIALS = r"(?iu)(?:materials?|made (?:from|of|with)|built (?:from|of|with))[:\s]+([^.;\n]{3,120})"
FABRICATION = r"(?iu)(?:fabricat(?:ed|ion)|constructed|built)[:\s]+([^.;\n]{3,120})"
TAGS = ("interactive", "light", "sound", "temple", "kinetic", "community", "solar")


def evidence_sentences(c: Column) -> Column:
    return F.filter(sentences(c), lambda s: F.rlike(s, F.lit(EVIDENCE)))


def materials(c: Column) -> Column:
    return F.nullif(clean_text(F.regexp_extract(text_of(c), MATERIALS, 1)), F.lit(""))


def fabrication(c: Column) -> Column:
    return F.nullif(clean_text(F.regexp_extract(text_of(c), FABRICATION, 1)), F.lit(""))


def tags(c: Column, most: int = 5) -> Column:
    """Keywords that a text mentions, in the order of the list."""
    low = text_of(c)
    return F.slice(F.filter(lit_array(TAGS), lambda t: F.contains(low, t)), 1, most)


def quoted(c: Column, always: bool = True) -> Column:
    """Cleaned text in double quotes; '' stays ''. ``always`` False quotes only texts with a blank."""
    text = clean_text(c)
    needs = (text != "") if always else F.rlike(text, F.lit(r"(?U)\s"))
    return F.when(needs, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def primary_name(c: Column) -> Column:
    """A credit's name before an 'aka' and before ' - '."""
    before = F.element_at(F.split(clean_text(c), r"(?iu)\ba\.?k\.?a\.?\b", 2), 1)
    return clean_text(F.element_at(F.split(before, " - ", 2), 1))


def alias_token(c: Column) -> Column:
    """The name after an 'aka', up to a comma, semicolon or bracket; NULL if none."""
    return F.nullif(clean_text(F.regexp_extract(clean_text(c), r"(?iu)\ba\.?k\.?a\.?\s+([^,;()]+)", 1)), F.lit(""))


def alias_key(c: Column) -> Column:
    return F.lower(clean_text(c))


def aliases_match(a: Column, b: Column) -> Column:
    """Equal after collapsing and lower-casing, or equal in letters and digits alone if three or more."""
    ka, kb = alias_key(a), alias_key(b)
    ca, cb = (F.regexp_replace(k, "[^a-z0-9]", "") for k in (ka, kb))
    return (ka != "") & (kb != "") & ((ka == kb) | ((ca == cb) & (F.length(ca) >= 3)))


def alias_mentioned(alias: Column, text: Column) -> Column:
    return (alias_key(alias) != "") & F.contains(alias_key(text), alias_key(alias))


#: Particles that stay in lower case inside a name.
PARTICLES = ("de", "da", "di", "von", "van", "la", "le")


def title_name(c: Column) -> Column:
    """Capitalize an all-lower-case name but for its particles; other texts stay."""
    text = clean_text(c)
    cased = F.array_join(F.transform(F.split(text, " "), lambda w: F.when(w.isin(*PARTICLES), w).otherwise(F.initcap(w))), " ")
    return F.when(text == F.lower(text), cased).otherwise(text)


def score_text(c: Column) -> Column:
    """Two decimals, half to even; NULL gives ''."""
    return F.coalesce(F.format_string("%.2f", F.bround(c, 2)), F.lit(""))


def bool_text(c: Column) -> Column:
    return F.coalesce(F.initcap(c.cast("string")), F.lit(""))
