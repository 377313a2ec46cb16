"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in os.listdir(SF):
        c.execute(f"CREATE VIEW {n[:-8]} AS SELECT * FROM '{SF}/{n}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name])
        assert sorted(df.columns) == sorted(d[0] for d in want.description)
        assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())


def test_text_queries_cover_documents(spark, duck):
    word = lambda w: f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){w}([^\\p{{L}}\\p{{N}}]|$)')"
    want = duck.execute(f"SELECT doc_id FROM documents WHERE {word('the')} AND {word('of')}").fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["text_index_search"](spark, SF).collect()) == sorted(want)
    ids = duck.execute("SELECT doc_id FROM documents").fetchall()
    assert sorted((r.doc_id,) for r in registry.QUERIES["text_headline"](spark, SF).collect()) == sorted(ids)


def test_copy_round_trip_copies_the_whole_table(spark, duck, monkeypatch):
    from marlstone.plans import queries_engines as qe

    copied, copy_to = [], qe.cp.copy_to
    monkeypatch.setattr(qe.cp, "copy_to", lambda rows, *a, **b: (copied.append(rows.count()), copy_to(rows, *a, **b)))
    registry.QUERIES["copy_round_trip"](spark, SF)
    assert copied == [duck.execute("SELECT count(*) FROM customer").fetchone()[0]]


def test_words_in_addresses_are_words(spark, duck, tmp_path):
    texts = ["end of.nbfs The end", "the@of.example", "the.of.com", "the_of", "3the of", "the apache.license", "see www.apache.org/license.txt", "apache-license", "the 5.of", "a-the.of-5", "Of\nTHE"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with duck.cursor() as c:
        c.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        for name in ("text_index_search", "text_filter"):
            want = c.execute(registry.SQL[name]).fetchall()
            assert want and sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)
