"""Registered queries against their SQL, and the pipeline against brute force, on the smallest data set."""

import hashlib
import os
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from augury.llm import bpe, near_duplicates
from augury.llm.common import table
from augury.llm.entry import load
from tests.llm import test_line_dedup, test_near_duplicates
from tests.llm.cases import awkward, nothing

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(map(tuple, frame.select(*columns).collect()), key=repr) == want


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_bpe_query(spark):
    library = Tokenizer.from_file(bpe.default_file())
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, DIR, "documents").collect()}
    rows = QUERIES["op2_bpe"](spark, DIR).collect()
    assert len(rows) == len(texts)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == sha(decoded.encode())


def test_near_duplicate_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, DIR, "documents").collect()]
    got = sorted(map(tuple, QUERIES["op3_hyperminhash"](spark, DIR).collect()), key=repr)
    assert got == test_near_duplicates.brute(rows, 85)


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.written(stage(spark, steps[-1], DIR), "test"))
    good, lines, near, clean, coded = steps[1:]
    assert all(s.columns == columns for s in steps[:-1])
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert set(rows(good)) <= set(rows(docs)) and 0 < good.count() < docs.count()
    want = test_line_dedup.brute(rows(good), test_line_dedup.L.Params())
    assert sorted(rows(lines), key=repr) == sorted(((d, t) for d, t, *_ in want), key=repr)
    kept = {d for d, _, _, k in test_near_duplicates.brute(rows(lines), 80) if k}
    assert {d for d, _ in rows(near)} == kept
    squeeze = lambda t: " ".join((t or "").lower().split())
    items = [squeeze(r["text"]) for r in table(spark, DIR, "benchmark").collect()]
    assert {d for d, _ in rows(clean)} == {d for d, t in rows(near) if not any(i in squeeze(t) for i in items)}
    library, texts = Tokenizer.from_file(bpe.default_file()), dict(rows(clean))
    for r in coded.collect():
        assert r["lossless"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    assert coded.count() == clean.count()


def test_pipeline_stages_bear_awkward_rows(spark):
    for docs in (awkward(spark), nothing(spark)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DIR)
            n = out.count()
            assert n <= docs.count() and (i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns)
    near = near_duplicates.near_duplicates(awkward(spark)).where("NOT kept").select("doc_id").distinct()
    assert {r["doc_id"] for r in near.collect()} == {2, 6, 10, 11}
