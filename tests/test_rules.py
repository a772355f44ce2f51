"""Credits, contributors, decisions and validation on literal rows."""

import pytest
from pyspark.sql import functions as F

from linkforge.operators import contract, keyed, ordering
from linkforge.operators.lookup import Index, fallback_lookup
from linkforge.operators.people import alias_linked, people_in
from linkforge.operators.rules import decide
from linkforge.operators.rules.contributor import with_cached_contributor, with_local_contributor
from linkforge.operators.rules.credit import with_credit
from linkforge.operators.schema import Field, Schema, validate

CREDITS = {
    "Jane Doe aka Sparkle": ("person_with_alias", "Jane Doe", "Sparkle"),
    "Sparkle a.k.a. Jane Doe": ("person_with_alias", "Jane Doe", "Sparkle"),
    "Sarah Gray, aka Sassy Galaxy": ("person_with_alias", "Sarah Gray", "Sassy Galaxy"),
    "Jane Doe (Sparkle)": ("person_with_alias", "Jane Doe", "Sparkle"),
    "Jane (Sparkle) Doe": ("person_with_alias", "Jane Doe", "Sparkle"),
    "Big Light Collective": ("collective", None, None),
    "Jane Doe": ("person", "Jane Doe", None),
    "Ben Lang with engineering by Ami Gonzo": ("multi_person", "Ben Lang; Ami Gonzo", None),
    "Glowworks art by Carl West and Tim Rob": ("multi_person", "Carl West; Tim Rob", "Glowworks"),
    "unbound (chris and anna de quero)": ("multi_person", "Chris; Anna de Quero", "unbound"),
    "firefly": ("alias_or_unknown", None, "firefly"),
    "": ("empty", None, None),
}


def test_credits(spark):
    df = spark.createDataFrame([(k,) for k in CREDITS], "credit string")
    got = {r.credit: (r.c.credit_type, r.c.legal_name, r.c.alias_name) for r in with_credit(df, "credit").collect()}
    assert got == CREDITS


def test_local_contributor(spark):
    df = spark.createDataFrame([("Ann Lee and Bo Kim",), ("The Spark Collective",), ("firefly",), ("",), ("Jane Q. Doe",)], "credit string")
    got = {r.credit: r.contributor for r in with_local_contributor(df, "credit").collect()}
    many = got["Ann Lee and Bo Kim"]
    assert (many.kind, many.display_name, many.additional_credits, many.last_name) == ("multiple", "Ann Lee", "Bo Kim", "Lee")
    assert got["The Spark Collective"].kind == "organization"
    assert got["firefly"].alias_name == "firefly" and "alias_uncertain" in got["firefly"].review_flags
    assert got[""].review_flags == ["contributor_kind_uncertain"]
    assert (got["Jane Q. Doe"].first_name, got["Jane Q. Doe"].last_name) == ("Jane", "Doe")


def test_cached_contributor(spark):
    fields = "archive_credit string, credit_type string, legal_name string, collective_name string, alias_name string, alias_confidence string, named_people string, identity_status string"
    rows = [(("A; B", "multi_person", "Ann Lee; Bo Kim", None, None, None, None, "resolved"),), (("firefly", "alias_or_unknown", None, None, "firefly", "medium", None, "needs_review"),)]
    df = spark.createDataFrame(rows, f"i struct<{','.join(x.strip().replace(' ', ':', 1) for x in fields.split(','))}>")
    many, alias = [r.c for r in with_cached_contributor(df, "i", F.lit(""), "c").collect()]
    assert (many.kind, many.display_name, many.additional_credits) == ("multiple", "Ann Lee", "Bo Kim")
    assert alias.alias_name == "firefly" and "identity_needs_review" in alias.review_flags


@pytest.mark.parametrize(
    "title, uid, warnings, active, images, review, expected",
    [
        (0.3, None, 1, 0, 0, False, "conflict"), (0.3, True, 1, 0, 2, False, "broken_link"), (0.9, False, 1, 1, 1, False, "likely_match"), (0.9, True, 0, 1, 1, True, "verified"),
        (0.9, True, 0, 1, 1, False, "verified_online"), (0.9, None, 0, 0, 0, False, "verified"), (0.6, True, 0, 0, 0, False, "likely_match"),
    ],
)
def test_match_status(spark, title, uid, warnings, active, images, review, expected):
    c = decide.match_status(F.lit(title), F.lit(uid).cast("boolean"), F.lit(warnings), F.lit(active), F.lit(images), F.lit(review))
    assert spark.range(1).select(c.alias("x")).first().x == expected


def test_lookup_precedence_and_veto(spark):
    cache = spark.createDataFrame([("u1", "Tree", "old", 1), ("u1", "Other", "new", 2), (None, "Tree", "x", 3), ("u8", "Moon", "a", 4), ("u9", "Moon", "b", 5)], "uid string, title string, v string, _ord int")
    differ = F.coalesce(F.col("_hit.uid") != F.col("_other.uid"), F.lit(False))
    base = spark.createDataFrame([(1, "u1", "Zzz"), (2, "none", "Tree"), (3, None, "Moon"), (4, None, None)], "id int, uid string, title string")
    got = {r.id: (r.hit.v if r.hit else None, r.hit_mode) for r in fallback_lookup(base, Index(cache, F.col("uid"), [F.col("title")], F.col("_ord"), differ), F.col("uid"), [F.col("title")], "hit").collect()}
    assert got == {1: ("new", "uid"), 2: ("old", "title"), 3: (None, ""), 4: (None, "")}


def test_strict_majority(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    assert {r.k: r.winner for r in ordering.strict_majority(df, ["k"], F.col("v")).collect()} == {1: "a", 2: None}


def test_upsert_and_eviction(spark):
    schema = "source_id int, canonical_url string, position int, record_row_id int, first_discovered_at string, record_json string, row_json string"
    old = spark.createDataFrame([(1, "a", 1, 10, "d1", "{}", None), (1, "b", 2, 11, "d1", None, None)], schema)
    new = spark.createDataFrame([(1, "b", 1, 12, "d2", '{"x":1}', None), (1, "a", 1, 10, "d2", None, None)][:1], schema)
    got = {r.canonical_url: r for r in keyed.upsert_by_canonical(old, new).collect()}
    assert got["a"].position == -10 and got["b"].position == 1 and got["b"].first_discovered_at == "d1" and got["b"].record_json == '{"x":1}'


def test_anti_insert_is_null_safe(spark):
    old = spark.createDataFrame([(1, None)], "k int, f string")
    new = spark.createDataFrame([(1, None, 1), (1, "x", 2), (1, "x", 3)], "k int, f string, pos int")
    assert [r.pos for r in keyed.anti_insert(old, new, ["k", "f"]).collect()] == [2]


def test_attempt_window(spark):
    rows = [(1, i, i not in (1, 2), i in (3, 5, 6, 7, 8)) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "g int, pos int, attempted boolean, succeeded boolean")
    got = sorted(r.pos for r in keyed.attempt_window(df, ["g"], F.col("pos"), F.lit(2)).collect())
    assert got == [1, 2, 3, 4, 5]


def test_people(spark):
    df = spark.createDataFrame([(1, "Lead artist: Jane Doe. Also Carl West Built it.")], "id int, text string")
    assert [p.name for p in people_in(df, ["id"], "text").first().people] == ["Jane Doe"]
    linked = spark.createDataFrame([(1, "Firefly (Jane Doe) and John Roe aka Firefly", "firefly"), (2, "Firefly lives here", "firefly")], "id int, text string, alias string")
    got = {r.id: sorted(p.name for p in r.people) for r in alias_linked(linked, ["id"], "text", "alias").collect()}
    assert got == {1: ["Jane Doe", "John Roe"]}


def test_validation_messages(spark):
    schema = Schema("1", (Field("a", True, rules=("non_empty",)), Field("y", rules=("year_or_empty",)), Field("k", rules=("one_of:x,y",))))
    df = spark.createDataFrame([("", "19999", "z"), ("ok", "", "x")], "a string, y string, k string")
    bad, good = [r.errors for r in validate(df, schema).collect()]
    assert [(e.field, e.message) for e in bad] == [("a", "required value missing"), ("a", "must be non-empty"), ("y", "expected four-digit year or empty"), ("k", "expected one of ['x', 'y']")]
    assert good == []


def test_contract_split(spark):
    rows = [("person", "Ann Lee", "Tree", "https://a.org/1", ""), ("studio", "Glow Works", "Moon", "", "duplicate_candidate"), ("", "", "", "null", "")]
    df = spark.createDataFrame(rows, "contributor_kind string, contributor_display_name string, project_title string, proof_external_url string, review_flags string")
    got = contract.validate_contract(contract.to_contract(df)).collect()
    assert [len(r.errors) == 0 for r in got] == [True, True, False]
    assert got[0].artist_name == "Ann Lee" and got[1].organization_name == "Glow Works" and got[1].artist_name == "" and got[1].review_status == "Duplicate"


def test_review_gate_and_priority(spark):
    gate = decide.review_status(F.lit("contributor_website"), F.lit("directly_stated"), F.lit("first_party"), F.lit(0.9), F.lit(True))
    kept = decide.review_status(F.lit("project_title"), F.lit("directly_stated"), F.lit("first_party"), F.lit(0.9), F.lit(True))
    flags = F.array(F.lit("hero_missing"), F.lit("duplicate_candidate"))
    row = spark.range(1).select(gate.alias("g"), kept.alias("k"), decide.review_priority(flags, F.lit(True), F.lit(False)).alias("p"), decide.format_flags(F.array(F.lit("x"), F.lit("hero_missing"), F.lit("hero_missing"))).alias("f")).first()
    assert (row.g, row.k, row.p, row.f) == ("approved", "unresolved", 175, "hero_missing")
