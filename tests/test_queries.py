"""Every registered query against its DuckDB equivalent on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from linkforge import oracles, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = queries.QUERIES | __spark_entry__.queries(), oracles.ORACLES | __spark_entry__.oracle_sql()
CHECKED = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]
#: Beyond SQL: an HTML parser's events, and name patterns with look-around.
NO_SQL = ("q33_people_dedupe", "q38_html_events")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in NO_SQL:
        return
    sql = ORACLES[name]
    answer = db.execute(sql)
    names = [x[0] for x in answer.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in answer.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["q51_page_readiness", "q51_publish_readiness"])
def test_titles_without_latin_letters(spark, tmp_path, name):
    pages = [(4, "https://x.example/a", "<title>Ç Éç Ç</title>"), (8, "https://x.example/b", "<title> </title>"), (12, "https://x.example/c", "<title>Île 2</title>"), (99, "https://x.example/d", "<title>日本</title>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    docs = [(i, "text " * 40, "en", "src0", 200) for i in (4, 8, 12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("pages", "documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    answer = con.execute(ORACLES[name])
    cols = [x[0] for x in answer.description]
    got = sorted(tuple(r[c] for c in cols) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(answer.fetchall())
    assert [r[-2:] for r in got] == [(0, True), (100, False), (1, True), (60, False)]


def test_entry(spark):
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0
