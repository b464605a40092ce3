"""The queries on the smallest tables against DuckDB, and the pipeline against its parts by brute force."""

import glob
import hashlib
import os
import struct

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from kinweave.llm import QUERIES, SQL, bpe, decontamination

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Rows of the queries without SQL that do not return one row per document.
ROWS = {"op10_html_text": 50, "op12_neighbours": 500, "op13_whitening": 16_000}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == sorted((tuple(r) for r in want.select(*df.columns).fetchall()), key=repr)
    else:
        assert name == "op5_decontamination" or len(got) == ROWS.get(name, 200)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, names = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.items() <= kept.items()
        gone = {i: t for i, t in kept.items() if i not in after}
        if name == "exact_dedup":
            assert len(set(after.values())) == len(after) and set(gone.values()) <= set(after.values())
            assert all(i < max(j for j, t in kept.items() if t == text) for i, text in gone.items())
        if name == "decontamination":
            items = [" ".join(decontamination.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            texts = {i: " ".join(decontamination.words_of(t)) for i, t in kept.items()}
            assert {i for i, t in texts.items() if any(x in t for x in items)} <= set(gone)
            assert all(min(decontamination.infix_distance(x, texts[i]) / len(x) for x in items) <= 0.2 for i in gone)
        kept = after
        names.append(name)
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination"]
    ranks = bpe.read_ranks(bpe.load_blob(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in corpus_pipeline.run(spark, SF).collect():
        ids = enc.encode_ordinary(kept.pop(r["doc_id"]) or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert not kept


def test_pipeline_keeps_odd_rows(spark, odd):
    """Rows with nulls and clashing columns pass the stages; only copies go."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    texts = [r["text"] or "" for r in docs.collect()]
    assert len(texts) == len(set(texts)) >= 6
