import corpus_pipeline
from foliant.llm import near_dedup, quality
from foliant.llm.catalog import ORACLES, QUERIES
from foliant.llm.common import staged

import duckdb
import os
import pytest
from test_exact_dedup import brute as exact_brute
from test_near_dedup import brute as near_brute


def test_stages(spark, sf):
    """Each stage against a plain version on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "source_mixing", "sentencepiece"]
    good = stages["quality"](spark, docs, sf).cache()
    weights = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    assert good.columns == docs.columns
    assert {i for i, _ in rows(good)} == {i for i, t in rows(docs) if quality.scores([t or ""], weights)[0] >= quality.THRESHOLD}
    one = stages["exact_dedup"](spark, good, sf).cache()
    assert {i for i, _ in rows(one)} == {r[0] for r in exact_brute(rows(good)) if r[3]} and one.columns == docs.columns
    near = stages["near_dedup"](spark, one, sf).cache()
    assert {i for i, _ in rows(near)} == {r[0] for r in near_brute(rows(one), 80) if r[3]} and near.columns == docs.columns
    mix = stages["source_mixing"](spark, near, sf).cache()
    assert mix.columns == docs.columns and set(rows(mix)) <= set(rows(near))
    last = stages["sentencepiece"](spark, mix, sf)
    assert last.count() == mix.count()
    assert corpus_pipeline.run(spark, sf).count() == mix.count()


@pytest.mark.parametrize("rows", ["awkward", "clashing", "empty"])
def test_stages_on_awkward_rows(spark, sf, rows, request, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing names and no rows at all."""
    docs = start = request.getfixturevalue(rows)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        docs = staged(quality.keep_good(docs, spark.read.parquet(f"{sf}/labels.parquet"), 0.0) if name == "quality" else stage(spark, docs, sf), f"file://{tmp_path}/{i}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "sentencepiece":
            assert len(ids) == size
            break
        size = len(ids)
        assert docs.columns == start.columns and {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()} <= before
        if rows == "empty":
            assert not ids
        elif name == "quality":
            assert size == start.count()
        elif name == "exact_dedup":
            assert sorted(ids) == [1, 2, 3, 5, 6, 8, 9, 10]
        elif name == "near_dedup":
            assert sorted(ids) == [1, 3, 5, 6, 8, 9, 10]
        elif name == "source_mixing":
            assert set(ids) <= {1, 6, 8, 9, 10} and len(ids) >= 4  # without words there is nothing to take


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_near_dedup_is_the_operator():
    assert QUERIES["op1_near_dedup"] is near_dedup.query
