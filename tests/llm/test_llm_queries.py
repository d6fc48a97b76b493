"""The registered queries: against DuckDB where there is SQL, else against the operators' plain functions."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from flowmill.llm import pii, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        at = f if os.path.isfile(f) else f"{f}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_pii_digests(spark, documents):
    got = queries.QUERIES["op7_pii"](spark, FOLDER).toPandas().set_index("doc_id")
    model = pii.default_tagger()
    assert len(got) == len(documents) and got[[f"n_{k}" for k in pii.KINDS]].to_numpy().sum() > 0
    for doc, text in zip(documents["doc_id"], documents["text"]):
        base = pii.plain_spans(text)
        row = got.loc[doc]
        assert row["base_sha256"] == pii.digest(base) and row["spans"] == pii.listed(base + pii.added_spans(text, base, model))
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]


def test_quality_query(spark, documents):
    from test_filters import brute, verdict

    got = queries.QUERIES["op2_quality"](spark, FOLDER).toPandas().set_index("doc_id")
    assert len(got) == len(documents)
    for doc, text in zip(documents["doc_id"], documents["text"]):
        n, chars, symbols, dup, again = brute(text)
        failed = n < 20 or 100 * again > 30 * n
        assert tuple(got.loc[doc]) == (n, chars, symbols, dup, again, failed, not failed and verdict(text)), doc


def test_mixing_query(spark, documents):
    from test_filters import WORD, targets

    got = queries.QUERIES["op5_mixing"](spark, FOLDER).toPandas().merge(documents, on="doc_id")
    sizes = documents.assign(n=[len(WORD.findall(t or "")) for t in documents["text"]]).groupby("source", dropna=False)["n"].sum().to_dict()
    want = targets({None if isinstance(k, float) else k: v for k, v in sizes.items()})
    assert len(got) == len(documents)
    for r in got.itertuples():
        n = len(WORD.findall(r.text or ""))
        assert (r.size, r.source_size) == (n, sizes[r.source]) and r.target == pytest.approx(want[r.source]) and r.taken in (0, n, 2 * n)


def test_toxicity_separates_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity"](spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    assert ((got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2) == got["held_out"]).all() and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    rank, pos = held["score"].rank(), held["toxic"] == 1
    assert (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()) > 0.95
    assert np.mean(held["predicted"] == held["toxic"]) > 0.95


def test_language_model_beats_the_unigrams_on_held_out_texts(spark):
    got = queries.QUERIES["op3_lm_score"](spark, "/root/testdata/sf0.1").toPandas()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and (got["score"] < 0).all()


def test_stages_are_registered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
