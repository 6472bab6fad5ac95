"""Versions of the store, ingestion in lots, version numbers, the stateless stream, long files."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docsluice.operators import chunk, embed, ingest, intake
from docsluice.operators.snapshots import Conflict, Snapshots
from docsluice.schema import PARSED
from docsluice.streaming.intake import file_stream, into_store, run_available


def rows_of(store, name="t"):
    return sorted(tuple(r) for r in store.read(name).collect())


def test_versions(spark, tmp_path):
    root = str(tmp_path / "s")
    make = lambda rows: spark.createDataFrame(rows, "file_id long, v string").coalesce(1)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "file_id long")
    one = Snapshots(spark, root).commit({"t": make([(i, "old") for i in range(1000)] + [(5, "also")]), "u": make([(1, "u")])}, ids(*range(1000)))
    before = {p for p in Path(root).rglob("part-*.parquet")}
    two = one.commit({"t": make([(5, "new")])}, ids(5, 6))
    assert len({p for p in Path(root).rglob("part-*.parquet")} - before) <= 1 + 2 * 4  # the file's rows, and the two ids
    assert sum(p.stat().st_size for p in set(Path(root, "t").rglob("part-*.parquet")) - before) < 2000
    # a reader of the first version sees it as it was, also now
    assert len(rows_of(one)) == 1001 and [r for r in rows_of(two) if r[0] in (5, 6)] == [(5, "new")] and len(rows_of(two)) == 999
    assert rows_of(two, "u") == [(1, "u")] and (one.version, two.version) == (1, 2)
    # killed after its data, before its manifest: nothing is seen of it
    make([(7, "lost")]).write.parquet(f"{root}/t/commit=cdead")
    assert rows_of(Snapshots(spark, root)) == rows_of(two) and Snapshots(spark, root).version == 2
    # two writers from one version: both count, one after the other; a third that insists on its version doesn't
    a, b = Snapshots(spark, root), Snapshots(spark, root)
    a.commit({"t": make([(8, "a")])}, ids(8))
    last = b.commit({"t": spark.createDataFrame([(8, "b", 1)], "file_id long, v string, more int")}, ids(8))
    assert [r for r in rows_of(last) if r[0] in (7, 8)] == [(7, "old", None), (8, "b", 1)]
    with pytest.raises(Conflict):
        b.commit({"t": make([(9, "x")])}, ids(9), expected=2)
    assert not last._put({"commits": []}, last.version)  # the number is taken
    whole = last.compacted()
    assert rows_of(whole) == rows_of(last) and len(whole._told["commits"]) == 1
    with pytest.raises(Conflict):
        last.compacted()
    whole.expire()
    assert rows_of(Snapshots(spark, root)) == rows_of(whole) and Snapshots(spark, root).versions() == [whole.version]


def test_lots_before_an_outage_stay(spark, tmp_path):
    class Tired:  # here, so that workers get it by value
        def embed_batch(self, texts):
            if any("seven" in t for t in texts):
                raise embed.Unreachable("no connection")
            return [[1.0, 0.0]] * len(texts)

    files = spark.createDataFrame([(i, "PENDING", 0, None) for i in range(8)], "file_id long, status string, retry_count int, fail_reason string")
    parsed = spark.createDataFrame([(i, [(1, ["word " * 5 + ("seven" if i == 7 else "")])], [], [], [], None, [], "txt") for i in range(8)], f"{PARSED}, file_type string")
    root = str(tmp_path / "s")
    lots = 4
    own = {r["file_id"]: r["lot"] for r in files.select("file_id", F.pmod(F.xxhash64("file_id"), F.lit(lots)).alias("lot")).collect()}
    with pytest.raises(embed.Unreachable):
        ingest.run(files, parsed, Tired, root, dim=2, lot=2, most=8, overlap=2, least=1)
    got = {r["file_id"]: r["status"] for r in Snapshots(spark, root).read("files").collect()}
    assert got == {i: "COMPLETED" if own[i] < own[7] else "PENDING" for i in range(8)}
    assert {r["file_id"] for r in Snapshots(spark, root).read("chunks").collect()} == {i for i in own if own[i] < own[7]} if own[7] else True


def test_versions_under_a_hot_name(spark):
    rng = random.Random(2)
    rows = [(i * 3, rng.choice(["hot", "hot", "b", "c", None]), rng.random() < 0.6) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "n long, name string, yes boolean").repartition(4)
    got = {r["n"]: r["nth"] for r in intake.running_count(df, "name", "n", "yes", "nth", stretch=100).collect()}
    seen, wanted = {}, {}
    for n, name, yes in sorted(rows):
        seen[name] = seen.get(name, 0) + yes
        wanted[n] = seen[name] if yes else None
    assert got == wanted


def test_stream_keeps_no_state(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 30}" if i % 31 else None) for i in range(120)], "doc_id long, text string")
    docs.repartitionByRange(6, "doc_id").write.parquet(str(tmp_path / "in"))
    sink = into_store(str(tmp_path / "taken"), ["doc_id"], "doc_id")
    query = run_available(file_stream(spark, str(tmp_path / "in"), docs.schema, per_batch=1), sink, str(tmp_path / "state"))
    query.awaitTermination()
    assert query.lastProgress.batchId == 5 and all(not p.stateOperators for p in query.recentProgress)
    stored = spark.read.parquet(str(tmp_path / "taken"))
    told = {r["checksum"]: r["doc_id"] for r in stored.collect()}
    assert stored.count() == len(told) == 31 and told[None] == 0
    sink(docs.where("doc_id >= 100"), 5)  # a batch that is done again
    assert spark.read.parquet(str(tmp_path / "taken")).count() == 31


def test_many_units_in_one_file(spark, tmp_path):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 3, 9, 40]) for _ in range(200_000)]
    spark.createDataFrame([(sizes,)], "s array<int>").write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    began = time.perf_counter()
    groups, merged = df.select(chunk.packed_groups(F.col("s"), 50), chunk.merged_groups(F.transform("s", lambda n: F.struct((n == 40).alias("is_table"), n.alias("token_count"))), 5, 12)).first()
    took = time.perf_counter() - began
    held, seg, wanted = 0, 0, []
    for n in sizes:
        if seg == 0 or held + n > 50:
            held, seg = 0, seg + 1
        held += n
        wanted.append(seg)
    assert list(groups) == wanted
    held, table, seg, wanted = 0, True, 0, []
    for n in sizes:
        if seg and not table and n != 40 and n < 5 and held + n <= 12:
            held += n
        else:
            held, table, seg = n, n == 40, seg + 1
        wanted.append(seg)
    assert list(merged) == wanted and took < 60
