"""What a task of the searches of many queries holds."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docsluice.operators import cells, retrieve


def _table(n, ids, name, seed):
    v = np.random.default_rng(seed).normal(size=(n, 32)).astype(np.float32)
    v[5], v[7], v[9] = v[3], 0, np.nan
    lists = [None if i % 501 == 11 else r[:9].tolist() if i % 700 == 13 else r.tolist() for i, r in enumerate(v)]
    return pa.table({ids: np.arange(n)[::-1].copy(), name: pa.array(lists, pa.list_(pa.float32()))})


def test_queries_add_up_only_rows_that_can_be_best():
    index, asked, added = _table(3000, "chunk_id", "embedding", 1), _table(40, "query_id", "vector", 2), []
    real = np.lexsort
    try:
        np.lexsort = lambda keys, *a, **k: (added.append(len(keys[0])), real(keys, *a, **k))[1]
        got = retrieve._batch_best(index, asked, 6)
    finally:
        np.lexsort = real
    assert sorted(added)[len(added) // 2] < 100  # 3000, when all rows were added up for all queries
    ids, vectors = index["chunk_id"].to_pylist(), index["embedding"].to_pylist()
    for query, v in zip(asked["query_id"].to_pylist(), asked["vector"].to_pylist(), strict=True):
        mine = [r for r in got.to_pylist() if r["query_id"] == query]
        if v is None or len(v) != 32 or not np.isfinite(v).all() or not any(v):
            continue
        want = []
        for i, w in zip(ids, vectors, strict=True):
            if w is not None and len(w) == 32:
                dot = norm_v = norm_w = 0.0
                for x, y in zip(v, w, strict=True):
                    dot, norm_v, norm_w = dot + x * y, norm_v + x * x, norm_w + y * y
                want.append((i, float("inf") if norm_w != norm_w else 0.0 if norm_w < 1e-12 else dot / (norm_v**0.5 * norm_w**0.5)))
        want = sorted(want, key=lambda x: (-x[1], x[0]))[:6]
        assert [r["chunk_id"] for r in mine] == [i for i, _ in want]


def test_nearest_centres_are_found_in_steps():
    x, centres = np.random.default_rng(3).normal(size=(6000, 8)), np.random.default_rng(4).normal(size=(1500, 8))
    tracemalloc.start()
    got = cells._nearest(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # three arrays of 6000 * 1500 numbers, 216 MB, before
    assert all(got[i] == ((centres - x[i]) ** 2).sum(1).argmin() for i in range(0, 6000, 500))
