"""People in running text: role lines, Title Case names, names linked to an alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import aliases_match, any_in, clean_text, lit_array, text_of
from linkforge.functions.urls import blocked_host
from linkforge.operators.ordering import merged_people
from linkforge.operators.rules.credit import is_legal_name
from linkforge.profile import DEFAULT, Profile

# Patterns of names.
NAME = r"[A-Z][a-z]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][a-z]+){1,2}"
ROLE_LINE = r"(?i:\b(?:(?:lead\s+)?artist|founded by|founders?|created by|co-?founders?|directed by|led by)\b)[:\s]+([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?(?:\s+[A-Z][a-z]+){1,3})"
ALIAS = r"[A-Za-z0-9][A-Za-z0-9'-]*(?:\s+[A-Za-z0-9][A-Za-z0-9'-]*){0,3}"
# How a text links a legal name and an alias; which group is the name.
ALIAS_LINKS = (
    (rf"(\b{NAME}\b)\s*,?\s*(?i:a\.?k\.?a\.?|also known as|known as|goes by)\s+['\"]?({ALIAS})['\"]?", 1),
    (rf"['\"]?({ALIAS})['\"]?\s*(?i:a\.?k\.?a\.?|also known as|real name(?:\s+is)?|legal name(?:\s+is)?)\s+(\b{NAME}\b)", 2),
    (rf"(\b{NAME}\b)\s*[(\[]\s*({ALIAS})\s*[)\]]", 1),
    (rf"({ALIAS})\s*[(\[]\s*(\b{NAME}\b)\s*[)\]]", 2),
    (rf"({ALIAS})\s*[(\[]\s*(?i:born)\s+(\b{NAME}\b)\s*[)\]]", 2),
)
# Tokens that no person's name has.
SKIP_TOKENS = ("the", "and", "with", "from", "for", "this", "that", "project", "website", "known", "man", "collective", "archive", "facebook", "instagram", "year", "born", "night", "inc", "llc", "camp", "crew", "team", "studio")
NO_PERSON = ("music", "songline", "lyrics", "lyric", "video", "official", "translation", "traduzione", "terjemahan", "tafsiri", "oversettelse", "amazon", "gallery", "contact", "home", "submit", "expense", "actions")
# Hosts that are never read for names, and marks of entertainment pages.
BLOCKED = ("instagram.com", "facebook.com", "twitter.com", "x.com", "tiktok.com", "youtube.com")
NOISE = ("comics", "fandom.com", "comicvine", "deviantart.com", "gamespot.com", "honkai", "batman", "characters/firefly", "tv_series", "lyrics", "genius.com", "songfacts")


def usable_name(name: Column, p: Profile = DEFAULT) -> Column:
    """Two to four Title Case words, none of them a stop word, no skipped phrase, digit or address."""
    words = F.split(name, " ")
    phrases = [x.lower() for x in p.skip_phrases]
    return (
        (text_of(name) != "") & ~any_in(F.lower(name), phrases) & F.size(words).between(2, 4) & ~F.exists(words, lambda w: F.lower(w).isin(*SKIP_TOKENS))
        & ~(F.contains(name, F.lit(".")) & ~name.rlike(r"\b[A-Z]\.")) & ~name.rlike(r"\d|www\.|http|@") & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    )


def looks_like_person(name: Column) -> Column:
    letters = F.array_remove(F.transform(F.split(clean_text(name), " "), lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z]", ""))), "")
    return F.size(letters).between(1, 4) & ~F.arrays_overlap(letters, lit_array(NO_PERSON))


def has_context(text: Column, p: Profile = DEFAULT) -> Column:
    return any_in(F.lower(text_of(text)), p.context_markers)


def is_noise_url(url: Column) -> Column:
    return any_in(F.lower(text_of(url)), NOISE)


def should_fetch(url: Column, domains=BLOCKED) -> Column:
    return ~blocked_host(url, domains)


def people_in(df: DataFrame, keys: list[str], text: str, base: float = 0.5, p: Profile = DEFAULT) -> DataFrame:
    """Per key an array ``people`` of (name, role, confidence): those on role lines, else up to five Title Case
    candidates."""
    line = F.transform(F.regexp_extract_all(text, F.lit(ROLE_LINE), F.lit(1)), clean_text)
    line = F.filter(line, lambda n: usable_name(n, p))
    free = F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"\b({NAME})\b"), F.lit(1)), clean_text), lambda n: usable_name(n, p))
    found = df.select(*keys, line.alias("_line"), free.alias("_free")).withColumn("_on_line", F.size("_line") > 0)
    rows = found.select(*keys, "_on_line", F.posexplode(F.when(F.col("_on_line"), F.col("_line")).otherwise(F.col("_free"))).alias("pos", "name"))
    rows = rows.select(*keys, "pos", "name", F.when(F.col("_on_line"), "named").otherwise("candidate").alias("role"), F.when(F.col("_on_line"), min(0.85, base + 0.25)).otherwise(base).alias("confidence"))
    merged = merged_people(rows, keys)
    return merged.withColumn("people", F.when(F.get("people", F.lit(0))["role"] == "candidate", F.slice("people", 1, 5)).otherwise(F.col("people")))


def alias_linked(df: DataFrame, keys: list[str], text: str, alias: str) -> DataFrame:
    """Per key an array ``people`` of legal names that a text links to the alias, confidence 0.92."""
    pairs = []
    for pattern, which in ALIAS_LINKS:
        names, others = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (which, 3 - which))
        pairs.append(F.zip_with(names, others, lambda n, a: F.struct(clean_text(n).alias("name"), clean_text(a).alias("alias"))))
    rows = df.select(*keys, F.col(alias).alias("_alias"), F.posexplode(F.concat(*pairs)).alias("pos", "x")).select(*keys, "pos", "x.name", F.col("x.alias").alias("_found"), "_alias")
    ok = aliases_match(F.col("_alias"), F.col("_found")) & is_legal_name(F.col("name")) & looks_like_person(F.col("name")) & (F.lower("name") != F.lower("_alias"))
    rows = rows.where(ok).select(*keys, "pos", "name", F.lit("alias_linked").alias("role"), F.lit(0.92).alias("confidence"))
    return merged_people(rows, keys)
