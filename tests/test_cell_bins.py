"""Searches of many queries by cells: small cells share a bin, and a query goes to a bin once."""

import numpy as np
import pyarrow as pa

from docsluice.operators import cells, retrieve


def test_bins_hold_whole_small_cells_and_parts_of_large_ones():
    sizes = {-1: 30, 0: 50, 1: 40, 2: 250, 3: 10, 4: 100, 5: 1}
    got = cells.bins_of(sizes, 100)
    assert got == {-1: (0, 1), 0: (0, 1), 1: (1, 1), 2: (2, 3), 3: (5, 1), 4: (6, 1), 5: (7, 1)}
    assert cells.bins_of({}, 100) == {}


def test_a_query_meets_the_rows_of_its_cells_that_reach_its_floor():
    rng = np.random.default_rng(5)
    rows, asked = rng.normal(size=(400, 6)), rng.normal(size=(30, 6))
    rows[7], rows[9] = rows[3], 0
    of = rng.integers(-1, 9, 400).astype(np.int32)
    floats = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    index = pa.table({"chunk_id": np.arange(400), "embedding": floats(rows), "cell": of})
    wanted = [rng.permutation(10)[: rng.integers(1, 6)].astype(np.int32) - 1 for _ in asked]
    for share in (0.0, 1.0):
        plain = {}
        for i, w in enumerate(wanted):
            plain[i] = retrieve._batch_best(index.filter(pa.array(np.isin(of, w))).drop_columns("cell"), pa.table({"query_id": [i], "vector": floats(asked[i : i + 1])}), 5).to_pylist()
        floors = [plain[i][2]["score"] if share and len(plain[i]) > 2 else None for i in plain]
        queries = pa.table({"query_id": np.arange(30), "vector": floats(asked), "floor": pa.array(floors, pa.float64()), "cells": pa.array(wanted, pa.list_(pa.int32()))})
        got = retrieve._batch_best(index, queries, 5).to_pylist()
        for i, floor in enumerate(floors):
            mine = [r for r in got if r["query_id"] == i]
            able = [r for r in plain[i] if floor is None or r["score"] >= floor]
            assert [r for r in mine if floor is None or r["score"] >= floor] == able


def test_a_query_is_sent_to_a_bin_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    index = cells.write_cells(rows, str(tmp_path / "index"), cells=20)
    asked = rows.where("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "embedding AS vector")
    sent = []

    def scratch(df):
        df = df.localCheckpoint()
        if "bin" in df.columns or "cell" in df.columns:
            sent.append(df.count())
        return df

    got = cells.top_of_many(index, asked, None, 5, retrieve._batch_best, scratch=scratch).collect()
    assert len(sent) == 2 and max(sent) <= 30  # a row for each cell before: 120 and up to 480
    want = retrieve._batch_best(rows.toArrow(), asked.toArrow(), 5).to_pylist()
    key = lambda r: (r["query_id"], -r["score"], r["chunk_id"])
    assert sorted((tuple(r) for r in got), key=lambda r: (r[0], -r[2], r[1])) == [tuple(r.values()) for r in sorted(want, key=key)]
