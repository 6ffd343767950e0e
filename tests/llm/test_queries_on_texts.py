"""Registered text queries against their SQL and against plain Python, over a whole small table."""

import glob
import os

import duckdb
import pytest
from brute import base_spans, sha, shingle_set

import __spark_entry__ as contract
from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    assert mine == sorted(tuple(map(repr, r)) for r in rel.select(", ".join(columns)).fetchall())


def test_all_are_registered():
    assert [n for n in QUERIES if n in contract.queries()] == list(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and "pipeline" in contract.queries()


def test_personal_data_query(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op1_pii"](spark, SF).collect()}
    for doc, text in docs:
        spans = [f"{k}:{s}:{e}" for k, s, e in base_spans(text)]
        assert got[doc].base_sha256 == sha(",".join(spans))
        assert not spans or set(spans) <= set(got[doc].spans.split(","))


def test_sketch_query(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, SF).collect()}
    for (doc, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[doc].n_chars == len(text) and got[doc].edited_sha256 == sha(edited)
        a, b = shingle_set(text), shingle_set(edited)
        assert abs(got[doc].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
