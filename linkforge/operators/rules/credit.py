"""Free-text credits to people, groups and aliases: an ordered cascade as one CASE over structs.

Each branch is a struct or NULL; the cascade is their COALESCE, so the order of rules is the order of
arguments. All of it is columns in a few projections; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import any_in, clean_text, ordered_unique_ci, title_name

# Substrings of a credit, padded by blanks, that mark a group.
GROUP_HINTS = ("collective", " crew", " team", "camp ", " studio", " arts", " project", " guild", " co.", " company", " monkeys", " founders")
# Words in brackets that are roles, not nicknames.
ROLE_WORDS = ("design", "build", "engineering", "engineer", "sound", "lights", "light", "fabricator", "fabrication", "producer", "lead", "artist", "optional", "final")
# The credit patterns.
AKA = r"(?iu)^(.+?)(,?\s+)(?:a\.?k\.?a\.?|also known as)\s+(.+)$"
BRACKET = r"^(.*?)\(([^)]+)\)(.*)$"
WITH_ROLE_BY = r"(?iu)^(.+?)\s+with\s+(?:engineering|design|fabrication|build|sound|lights?)\s+by\s+(.+)$"
ART_BY = r"(?iu)^(.+?)\s+art by\s+(.+)$"
BRACKETED_PEOPLE = r"^([^(]+)\(\s*([^)]+)\s*\)\s*$"
BETWEEN_PEOPLE = r"(?iu)\s*(?:,|/|&|;|\band\b)\s*"
JOINED = r"(?iu)\b(?:and|&|,|/)\b"
HONORIFIC = r"(?iu)^(mr|mrs|ms|dr)\.?\s+"

STRINGS = "array<string>"


def is_group(c: Column) -> Column:
    return any_in(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), GROUP_HINTS)


def _words(c: Column) -> Column:
    return F.array_remove(F.split(clean_text(c), " "), "")


def is_legal_name(c: Column) -> Column:
    """Two words or more, at most six with letters, half of them (one at least) capitalized, and no group."""
    words = F.array_remove(F.split(F.regexp_replace(clean_text(c), HONORIFIC, ""), " "), "")
    letters = F.array_remove(F.transform(words, lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), "")
    capital = F.size(F.filter(letters, lambda w: w.rlike("^[A-Z]")))
    return ~is_group(c) & (F.size(words) >= 2) & F.size(letters).between(1, 6) & (capital >= F.greatest(F.lit(1), F.floor(F.size(letters) / 2)))


def is_stage_name(c: Column) -> Column:
    """One word, or up to three that are no legal name, and no group."""
    n = F.size(_words(c))
    return (n > 0) & ~is_group(clean_text(c)) & ((n == 1) | ((n <= 3) & ~is_legal_name(c)))


def _capital_word(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}\p{Ll}+$")


def people_of(c: Column) -> Column:
    """Names in a credit: legal names and single capitalized words between separators, distinct; 'the ...' groups
    are left out, and 'and the ...' stays with what it follows."""
    text = F.regexp_replace(clean_text(c), r"(?iu)\s+and the\s+", " & the ")
    parts = F.array_remove(F.transform(F.split(text, BETWEEN_PEOPLE), clean_text), "")
    keep = F.filter(parts, lambda p: ~(F.lower(p).startswith("the ") & is_group(p)) & (is_legal_name(p) | ((F.size(_words(p)) == 1) & p.rlike(r"^\p{Lu}"))))
    return ordered_unique_ci(keep)


def _result(kind, *, legal=None, alias=None, group=None, people=None, aliases=None, search=False, confidence="none", note=None) -> Column:
    none, empty = F.lit(None).cast("string"), F.array().cast(STRINGS)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(kind).alias("credit_type"),
        (none if legal is None else legal).alias("legal_name"),
        (none if alias is None else alias).alias("alias_name"),
        (none if group is None else group).alias("collective_name"),
        (empty if people is None else people).alias("named_people"),
        (empty if aliases is None else aliases).alias("aliases"),
        as_col(search).alias("needs_search"),
        as_col(confidence).alias("alias_confidence"),
        (none if note is None else F.lit(note)).alias("note"),
    )


#: What each pattern of a credit gives: group numbers of its parts.
_PARTS = {
    "aka": (AKA, {"left": 1, "sep": 2, "right": 3}),
    "nick": (BRACKET, {"before": 1, "nick": 2, "after": 3}),
    "role": (WITH_ROLE_BY, {"head": 1, "tail": 2}),
    "art": (ART_BY, {"head": 1, "tail": 2}),
    "who": (BRACKETED_PEOPLE, {"head": 1, "tail": 2}),
}


def _credited(k: str, joined: bool) -> Column:
    """People that a pattern credits, from its staged columns."""
    people, head, tail = (F.col(f"_{k}_{x}") for x in ("people", "head", "tail"))
    brand = F.when((head != "") & ~F.col(f"_{k}_legal"), head)
    shown = F.when(F.col(f"_{k}_stage") & brand.isNotNull(), brand)
    found = _result(
        F.when(F.size(people) > 1, "multi_person").otherwise("person"), legal=F.array_join(people, "; "), alias=shown, people=people,
        aliases=F.array_compact(F.array(brand)), confidence=F.when(shown.isNotNull(), "medium").otherwise("none"), note="Extracted named people from credit or role phrasing.",
    )
    fits = (tail != "") & (F.size(people) > 0)
    return F.when(fits & tail.rlike(JOINED) if joined else fits, found)


def with_credit(df: DataFrame, column: str, out: str = "c") -> DataFrame:
    """Add a struct: credit, credit_type, legal_name, alias_name, collective_name, named_people, aliases,
    needs_search, alias_confidence, note. Rules in order: empty, aka, bracketed nickname, credited people, groups,
    several people, one person, alias or unknown. What several rules share is a column of its own, computed once."""
    have = df.columns
    df = df.withColumn("_credit", clean_text(F.col(column)))
    credit = F.col("_credit")
    df = df.withColumns({f"_{k}_{n}": F.regexp_extract(credit, p, g) if n == "sep" else clean_text(F.regexp_extract(credit, p, g)) for k, (p, gs) in _PARTS.items() for n, g in gs.items()})
    df = df.withColumn("_aka_left", clean_text(F.rtrim(F.col("_aka_left"), F.lit(",")))).withColumn("_nick_legal", clean_text(F.concat_ws(" ", "_nick_before", "_nick_after")))
    tests = {"_aka_a": is_legal_name(F.col("_aka_left")), "_aka_b": is_legal_name(F.col("_aka_right")), "_aka_sa": is_stage_name(F.col("_aka_left")), "_aka_sb": is_stage_name(F.col("_aka_right"))}
    tests |= {"_nick_ok": is_legal_name(F.col("_nick_legal")), "_people": people_of(credit), "_group": is_group(credit), "_legal": is_legal_name(credit), "_stage": is_stage_name(credit)}
    for k in ("role", "art", "who"):
        tests |= {f"_{k}_legal": is_legal_name(F.col(f"_{k}_head")), f"_{k}_stage": is_stage_name(F.col(f"_{k}_head")), f"_{k}_named": people_of(title_name(F.col(f"_{k}_tail")))}
    tests["_role_first"] = people_of(F.col("_role_head"))
    df = df.withColumns(tests)
    raw = {}
    for k in ("role", "art", "who"):
        loose = F.array_remove(F.transform(F.split(F.col(f"_{k}_tail"), BETWEEN_PEOPLE), title_name), "")
        named = F.col(f"_{k}_named")
        raw[f"_{k}_raw"] = F.concat(F.col("_role_first"), named) if k == "role" else F.when(F.size(named) > 0, named).otherwise(loose)
    df = df.withColumns(raw)
    real = lambda k: F.filter(ordered_unique_ci(F.array_remove(F.transform(f"_{k}_raw", title_name), "")), lambda p: (is_legal_name(p) | _capital_word(p)) & ~is_group(p))
    df = df.withColumns({f"_{k}_people": real(k) for k in ("role", "art", "who")})

    left, right, a, b = (F.col(f"_aka_{x}") for x in ("left", "right", "a", "b"))
    left_legal = (a & ~b) | (a & b & F.contains("_aka_sep", F.lit(","))) | (a & F.col("_aka_sb"))
    right_legal = (b & ~a) | (b & F.col("_aka_sa"))
    df = df.withColumn("_aka_legal", F.when(left_legal, left).when(right_legal, right)).withColumn("_aka_alias", F.when(left_legal, right).otherwise(left))
    df = df.withColumns({"_aka_people": people_of(F.col("_aka_legal")), "_aka_both": people_of(F.concat_ws("; ", left, right))})
    legal, alias, people = F.col("_aka_legal"), F.col("_aka_alias"), F.col("_aka_people")
    clear = _result(
        "person_with_alias", legal=legal, alias=alias, people=F.when(F.size(people) > 0, people).otherwise(F.array(legal)), aliases=F.array(alias),
        search=is_group(legal) | (F.size(people) > 3), confidence="high", note="Separated via explicit aka pattern.",
    )
    unclear = _result("alias_pair", people=F.col("_aka_both"), aliases=F.array(left, right), search=True, note="aka present but sides were ambiguous; the alias is left blank.")
    aka = F.when((left != "") & (right != ""), F.when(legal.isNotNull(), clear).otherwise(unclear))

    nick, full = F.col("_nick_nick"), F.col("_nick_legal")
    words = _words(F.lower(nick))
    plain = ~any_in(F.lower(nick), ("+", "/", "&", " and ")) & F.size(words).between(1, 3) & ~F.exists(words, lambda w: w.isin(*ROLE_WORDS)) & ~nick.rlike(r"\d")
    nickname = F.when((nick != "") & plain & F.col("_nick_ok"), _result("person_with_alias", legal=full, alias=nick, people=F.array(full), aliases=F.array(nick), confidence="high", note="Separated via parenthetical nickname."))

    people, group, stage = F.col("_people"), F.col("_group"), F.when(F.col("_stage"), credit)
    groups = _result(F.when((F.size(people) == 0) | group, "collective").otherwise("hybrid"), group=F.when(group, credit), people=people, search=True, note="Group credit; search for members.")
    found = F.coalesce(
        F.when(credit == "", _result("empty")), aka, nickname, _credited("role", False), _credited("art", False), _credited("who", True), F.when(group, groups),
        F.when(F.size(people) > 1, _result("multi_person", legal=F.array_join(people, "; "), people=people, note="Several named people in the credit.")),
        F.when(F.col("_legal"), _result("person", legal=credit, people=F.array(credit))),
        _result("alias_or_unknown", alias=stage, people=F.array(credit), search=True, confidence=F.when(stage.isNotNull(), "low").otherwise("none"), note="Credit may be an alias or brand; search for the legal identity."),
    )
    return df.withColumn("_found", found).select(*[F.col(f"`{c}`") for c in have if c != out], F.struct(F.col("_credit").alias("credit"), "_found.*").alias(out))
