"""The pipeline's stages on a small corpus, against what each stage must do to its input."""

import corpus_pipeline
import pytest
from test_llm import _base

from marlstone.llm import queries
from marlstone.llm.common import lowered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark, steps):
    docs, good, single, apart, masked, packed = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "pii", "packing"]
    assert all(s.columns == docs.columns for s in steps[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    assert good.join(labels.select("doc_id"), "doc_id", "left_semi").count() >= 0.95 * labels.count()
    texts = [r.text for r in good.collect()]
    assert single.count() == len(set(texts)) and {r.text for r in single.collect()} == set(texts)

    rows = [(r.doc_id, set(zip(*(lowered(r.text).split()[k:] for k in range(5)), strict=False))) for r in apart.collect()]
    for i, (_, x) in enumerate(rows):
        for _, y in rows[:i]:
            assert not x or not y or len(x & y) / len(x | y) < 0.82
    before = {r.doc_id: r.text for r in apart.collect()}
    after = {r.doc_id: r.text for r in masked.collect()}
    assert before.keys() == after.keys()
    assert all(not _base(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not any(c.isdigit() or c == "@" for c in t))
    assert packed.selectExpr("sum(n_tokens)").first()[0] == sum(len(lowered(t).split()) for t in after.values())


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[-1].count()


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_stages_on_awkward_tables(spark, tmp_path, kind):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, n_tokens int"
    long = " ".join(f"word{i % 977} mail{i}@example.org" for i in range(5_000))
    texts = [(1, "the same words stand in this text here"), (2, "the same words stand in this text here"), (2, "the same words stand in this text here"), (3, None), (4, ""), (None, "other words that stand alone"), (None, None), (7, long), (8, long + " y"), (9, " \n\t ")]
    rows = [(i, t, None if i is None else "en", None, None, "d", 1) for i, t in texts] if kind == "awkward" else []
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None), (7, 0, None)][: len(rows)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"{n}.parquet")
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
        if name == "exact_dedup":
            assert docs.groupBy("text").count().where("count > 1").count() == 0
        if name == "pii":
            assert before.count() == docs.count() and docs.where("text LIKE '%@example.org%'").count() == 0
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) is (kind == "awkward")


def test_registered_queries(spark):
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 11)]
    for name, sql in queries.SQL.items():
        import duckdb

        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        df = queries.QUERIES[name](spark, SF)
        want = c.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())
