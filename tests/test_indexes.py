"""The stored indexes against scans of all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsluice.operators import cells, postings, retrieve

FILES = "file_id long, file_name string, doc_scope string, language string, doc_version int"
CHUNKS = "chunk_id long, file_id long, chunk_text string, chunk_text_norm string, page_number int, section_title string"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """300 chunks of a few words, some accented, many equal scores; a word in most of them; null and empty texts."""
    rng, words = random.Random(5), "a nation née nee Übung ubung station relation x1 retion the".lower().split()
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))) for i in range(300)} | {7: None, 8: "", 9: "  ,;. ", 10: "the " * 50 + "née " * 50}
    files = spark.createDataFrame([(i, f"f{i}", f"s{i % 4}", "de" if i % 3 else "en", 1) for i in range(100)], FILES)
    chunks = spark.createDataFrame([(3 * i, i % 100, t, t, 1, "A" if i % 2 else None) for i, t in texts.items()], CHUNKS).repartition(5)
    root = str(tmp_path_factory.mktemp("index"))
    stored = {kind: postings.write_postings(chunks, f"{root}/{kind}", kind, slice_chunks=8) for kind in postings.KINDS}
    return chunks, files, stored


@pytest.mark.parametrize("looks", [1, 64])
def test_postings_equal_a_scan(library, monkeypatch, looks):
    chunks, files, stored = library
    monkeypatch.setattr(postings, "FIRST_BLOCKS", looks)
    told = lambda df: [(r["chunk_id"], round(r["score"], 6), r["rank"], r["source"]["file_name"]) for r in df.orderBy("rank").collect()]
    asked = [("the", "simple"), ("the née", "simple"), ("nation the a", "simple"), ("nee", "unaccent"), ("ubung née the", "unaccent"), ("nation retion", "trgm"), ("zzz", "simple"), ("the zzz", "simple"), ("", "simple")]
    for i, (query, variant) in enumerate(asked if looks == 1 else asked[1:6:2]):
        index = stored["trigrams" if variant == "trgm" else "words"]
        k, where = ((20, F.col("section_title") == "A"), (4, None))[i % 2]
        args = (chunks, files, query, ["s0", "s1", "s2"], k, variant, where)
        assert told(retrieve.search_lexical(*args, index=index)) == told(retrieve.search_lexical(*args)), (query, variant, k)


def test_postings_read_the_asked_folders(library, spark):
    _, _, stored = library
    index = stored["words"]
    own = index.blocks.where("term = 'the'").select("bucket").distinct().collect()
    plan = postings.blocks_of(index, ["the"])._jdf.queryExecution().executedPlan().toString()
    assert len(own) == 1 and f"bucket#" in plan and f"IN ({own[0][0]})" in plan.replace("[", "(") or f"= {own[0][0]})" in plan
    assert "PartitionFilters: []" not in plan and "PushedFilters: [In(term, [the])" in plan or "EqualTo(term,the)" in plan
    counts = postings.blocks_of(index, ["the"]).select("asked", "n", "best")._jdf.queryExecution().executedPlan().toString()
    assert "places" not in counts.split("ReadSchema")[1]
    whole = {r["term"]: (r["chunks"], r["occurrences"]) for r in postings.term_counts(index).collect()}
    assert whole["the"][1] > whole["the"][0] > 100 and whole["née"][0] > 0 and "" not in whole


def test_index_of_nothing(spark, tmp_path, library):
    chunks, files, stored = library
    index = postings.write_postings(chunks.limit(0), str(tmp_path / "p"))
    assert retrieve.search_lexical(chunks, files, "the a", ["s0"], index=index).count() == 0
    assert retrieve.search_lexical(chunks, files, "the", [], index=stored["words"]).count() == 0
    with pytest.raises(ValueError):
        retrieve.search_lexical(chunks, files, "the", ["s0"], variant="trgm", index=stored["words"])
    with pytest.raises(ValueError):
        postings.write_postings(chunks, str(tmp_path / "q"), "letters")


def clustered(n=3000, dims=12, seed=3):
    """Groups around far centres, copies of one vector for a third, and rows without a direction."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, dims))[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, dims))
    x[: n // 3] = x[0]
    rows = [(int(i), [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    return [*rows, (n, None), (n + 1, [0.0] * dims), (n + 2, [1.0, 2.0]), (n + 3, [float("nan")] * dims), (n + 4, [None] + [1.0] * (dims - 1))]


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    rows = clustered()
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(4)
    chunks = spark.createDataFrame([(i, i % 50, "t", "t", 1, None) for i, _ in rows], CHUNKS)
    files = spark.createDataFrame([(i, f"f{i}", f"s{i % 2}", "de", 1) for i in range(50)], FILES)
    return chunks, vectors, files, cells.write_cells(vectors, str(tmp_path_factory.mktemp("cells") / "c"), cells=30), dict(rows)


def test_cells_equal_a_scan(space):
    chunks, vectors, files, index, rows = space
    told = lambda df: [(r["chunk_id"], str(r["score"])) for r in df.orderBy("rank").collect()]
    assert index.rows.count() == len(rows)
    for q in (rows[2000], rows[5], [0.0] * 12):
        assert told(retrieve.search_dense(chunks, vectors, files, q, ["s1"], 7, index=index)) == told(retrieve.search_dense(chunks, vectors, files, q, ["s1"], 7))
    assert retrieve.search_dense(chunks, vectors, files, rows[5], [], index=index).count() == 0


def test_cells_of_many_queries(space, spark):
    chunks, vectors, files, index, rows = space
    save = lambda df: spark.createDataFrame(df.collect(), df.schema)
    asked = spark.createDataFrame([(i, rows[i]) for i in (0, 1500, 2100, 2999)] + [(9001, [0.0] * 12)], "query_id long, vector array<float>")
    args = (chunks, files, asked, ["s0", "s1"], 6)
    got = retrieve.search_cells_batch(index, *args, scratch=save)
    wanted = retrieve.search_dense_batch(chunks, vectors, files, asked, ["s0", "s1"], 6)
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], f"{r['score']:.9f}") for r in df.collect())
    assert key(got) == key(wanted)
    quick = {(r["query_id"], r["chunk_id"]) for r in retrieve.search_cells_batch(index, *args, exact=False, scratch=save).collect()}
    assert len(quick & {(r[0], r[2]) for r in key(wanted)}) >= 0.9 * len(key(wanted))


def test_bounds_leave_few_cells(space):
    _, _, _, index, rows = space
    at, q = cells._centres(index), np.array(rows[2000])
    d = np.sqrt(((at.centre - q / np.linalg.norm(q)) ** 2).sum(1))
    assert at.odd and len(at.cell) >= 25 and len(cells.able_cells(at, d, cells._reach(0.99))) <= 3
    assert len(cells.able_cells(at, d, np.inf)) == len(at.cell)
