"""The registered queries against their SQL, the pipeline stage by stage, and what may import what."""

import pathlib
import re

import pytest

import corpus_pipeline
from funnelworks.llm import queries
from funnelworks.llm.oracle import oracle_sql
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parents[2]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    got = queries.REGISTRY[name](spark, SF)
    con = duck(SF).execute(oracle_sql()[name])
    ok, why = compare(got.columns, [tuple(r) for r in got.collect()], [c[0] for c in con.description], con.fetchall())
    assert ok, why


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.REGISTRY) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(out)
        tables[name] = docs = spark.read.parquet(out)
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
    texts = {k: {r.doc_id: r for r in t.collect()} for k, t in tables.items()}
    known = [k for k, r in texts["start"].items() if r.text and re.search(r"[^\W\d_]", r.text)]
    assert sorted(texts["language_id"]) == sorted(known)
    groups = queries.simhash.near_duplicates(tables["language_id"]).collect()
    assert sorted(texts["simhash_near_dedup"]) == sorted({r.component_id for r in groups})
    assert tables["simhash_near_dedup"].count() == len(texts["simhash_near_dedup"])
    spans = {r.doc_id: r.spans for r in queries.pii.find(tables["simhash_near_dedup"]).collect()}
    for k, r in texts["pii"].items():
        before = texts["simhash_near_dedup"][k].text
        assert (r.text == before) == (not spans[k]) and r.n_chars == len(r.text)
        if spans[k]:
            a, b = map(int, spans[k].split(",")[0].split(":")[1:])
            assert r.text.startswith(before[:a] + "<") and before[a:b] not in r.text[:a + 7]
    assert set(texts["mixing"]) <= set(texts["pii"]) and all(texts["mixing"][k] == texts["pii"][k] for k in texts["mixing"])
    assert tables["sentencepiece"].count() == tables["mixing"].count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_else_imports_the_package():
    for path in ROOT.glob("funnelworks/**/*.py"):
        if "llm" not in path.parts:
            assert "funnelworks.llm" not in path.read_text(), path
