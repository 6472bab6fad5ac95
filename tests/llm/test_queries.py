from __future__ import annotations

import os
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from docsluice.llm.common import Scratch

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, expected = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].itertuples(index=False))) == sorted(map(tuple, expected[columns].itertuples(index=False)))


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_query_columns(spark, name):
    df = entry.queries()[name](spark, DATA)
    wanted = {
        "op1": "doc_id n_bytes n_removed n_spans kept_sha256", "op2": "doc_id item_id distance", "op3": "doc_id section n_tokens", "op4": "doc_id n_shingles component_id",
        "op5": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6": "doc_id n_tokens ids_sha256 decoded_sha256", "op7": "query_id rank vec_id score",
        "op8": "doc_id held_out lang_pred score", "op9": "doc_id start n_tokens ids_crc32", "op10": "doc_id size text_crc32 law shard slot grown_shard",
        "op11": "doc_id n_lines n_dropped kept_sha256", "op12": "doc_id leaf subroot root proof_sha256 folded_root verified",
        "op13": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    }[name.split("_")[0]]
    assert set(wanted.split()) <= set(df.columns)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name.split("_")[0] not in ("op2", "op3", "op7"):
        assert df.count() == docs


def test_shards_equal_the_law(spark):
    rows = entry.queries()["op10_sharding"](spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    wanted = sorted((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == wanted
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)}
    assert sum(map(len, slots.values())) == len(rows) and all(x == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "123 456", "en", "s", 7)], docs.schema)
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    now = docs.union(extra).union(spark.createDataFrame([(10_004, f"Alone here {benchmark} and there", "en", "s", 9)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, Scratch(spark).saved(stage(spark, now, DATA), name)
        assert now.columns == docs.columns and 0 < now.count() <= before.count()
        ids = {r[0] for r in now.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {10_001, 10_002, 10_003} and now.count() == before.count() - 3
        if name == "benchmark_decontamination":
            assert 10_004 not in ids
    out = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert out.count() == now.count() and out.where(F.col("n_tokens") == 0).count() == 0

