"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from linkforge.functions import text as t, urls as u, values as v


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "make, expected",
    [
        (lambda: t.normalize_title(F.lit("  The Héllo -- World!! ")), "the h llo world"),
        (lambda: t.slugify(F.lit("A  Big_Thing (2)")), "a-big-thing-2"),
        (lambda: t.clean_text(F.lit("\t a   b\n")), "a b"),
        (lambda: t.clean_text(F.lit(None).cast("string")), ""),
        (lambda: t.blank(F.lit("   ")), None),
        (lambda: t.first_nonblank(F.lit(" "), F.lit(None).cast("string"), F.lit(" x ")), "x"),
        (lambda: t.clean_cell(F.lit(" Null ")), ""),
        (lambda: t.pipe_join(F.lit("a;b|a"), F.lit("-"), F.lit('["c|d", "b"]')), "a|b|c|d"),
        (lambda: t.similarity(F.lit(""), F.lit(None).cast("string")), 1.0),
        (lambda: t.similarity(F.lit("a"), F.lit("")), 0.0),
        (lambda: t.similarity(F.lit("Red Tree"), F.lit("the red tree")), 2 / 3),
        (lambda: t.artist_similarity(F.lit("by: Ann Lee"), F.lit("Ann Lee")), 1.0),
        (lambda: t.artist_names(F.lit("by Ann and Bo, Cy & Di")), ["Ann", "Bo", "Cy", "Di"]),
        (lambda: t.strip_site_suffix(F.lit("Title | Site - x")), "Title"),
        (lambda: t.near_contains(F.lit("a big red wooden tree"), F.lit("Big Red Tree")), True),
        (lambda: t.near_contains(F.lit("a tree"), F.lit("Big Red Tree")), False),
        (lambda: t.ordered_unique_ci(F.array(F.lit("b"), F.lit("A"), F.lit("B"), F.lit("a"))), ["b", "A"]),
        (lambda: t.materials(F.lit("It was made of wood and steel. More.")), "wood and steel"),
        (lambda: t.tags(F.lit("solar light temple sound kinetic community")), ["light", "sound", "temple", "kinetic", "community"]),
        (lambda: t.primary_name(F.lit("Ann Lee aka Bo - Studio")), "Ann Lee"),
        (lambda: t.alias_token(F.lit("Ann Lee a.k.a. Bo Ray, Studio")), "Bo Ray"),
        (lambda: t.title_name(F.lit("anna de quero")), "Anna de Quero"),
        (lambda: t.aliases_match(F.lit("Fire-Fly"), F.lit("firefly")), True),
        (lambda: t.score_text(F.lit(0.125)), "0.12"),
        (lambda: t.bool_text(F.lit(None).cast("boolean")), ""),
        (lambda: u.normalize_url(F.lit(" HTTP://Ex_ample.org/A b?b=2&utm_source=x&a=%7E*#f ")), "http://ex_ample.org/A b?a=~%2A&b=2"),
        (lambda: u.candidate_url(F.lit("https://a.org/x#a2I9")), "https://a.org/x#a2I9"),
        (lambda: u.absolute(F.lit("https://a.org/x/y.html?q=1"), F.lit("../z")), "https://a.org/z"),
        (lambda: u.absolute(F.lit("https://a.org/x/y"), F.lit("//b.org/z")), "https://b.org/z"),
        (lambda: u.absolute(F.lit("https://a.org"), F.lit("z")), "https://a.org/z"),
        (lambda: u.http_url(F.lit("ftp://a.org")), ""),
        (lambda: u.url_year(F.lit("https://a.org/2019/x?yyyy=2021")), "2021"),
        (lambda: u.url_year(F.lit("https://a.org/2019")), "2019"),
        (lambda: u.uid_of(F.lit("https://a.org/x#a2Iabc9")), "a2Iabc9"),
        (lambda: u.host(F.lit("HTTPS://me@WWW.A.org:80/x")), "www.a.org"),
        (lambda: v.year_text(F.lit("built in 1998 or 2001")), "1998"),
        (lambda: v.as_int(F.lit(" 12 ")), 12),
        (lambda: v.as_int(F.lit("12x")), None),
        (lambda: v.record_id(F.lit("abc")), "ba7816bf8f01cfea"),
    ],
)
def test_literal(spark, make, expected):
    got = one(spark, make())
    assert got == (pytest.approx(expected) if isinstance(expected, float) else expected)
