"""What the suffix order of a bucket's stretches takes."""

import random

import numpy as np

from docsluice.llm import suffix_dedup


def test_suffix_order_sorts_keys_with_their_places(monkeypatch):
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab\x00") for _ in range(150)) * 2 + b"\xff" + bytes(rng.choice(b"ab\x00") for _ in range(300)) + b"\xff"
    ends = np.array([300, len(data) - 1])
    starts = np.concatenate([np.arange(a, b) for a, b in ((0, 300), (301, len(data) - 1))])
    room = ends[np.searchsorted(ends, starts, "right")] - starts
    expected = []
    for s, r in zip(starts.tolist(), room.tolist()):
        same = lambda n: [x for x, y in zip(starts.tolist(), room.tolist()) if x != s and y >= n and r >= n and data[x : x + n] == data[s : s + n]]  # noqa: B023, E731
        expected.append(tuple(max((n for n in (8, 20) if any(keep(x) for x in same(n))), default=0) for keep in (lambda x: x < s, lambda x: True)))  # noqa: B023

    def slow(*_, **__):
        raise AssertionError("a sort by argument, several times the time of one of values")

    for name in ("unique", "lexsort", "argsort"):
        monkeypatch.setattr(suffix_dedup.np, name, slow)
    assert list(zip(*(x.tolist() for x in suffix_dedup.factors_at(np.frombuffer(data, np.uint8), starts, room, [8, 20])), strict=True)) == expected
    assert {(0, 0), (8, 8), (20, 20), (0, 20)} <= set(expected)


def test_runs_of_all_stretches_are_found_at_once():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 6, 200)
    edges, flags = np.append(0, np.cumsum(sizes)), rng.random(sizes.sum()) < 0.6
    found = suffix_dedup._runs(flags, edges)
    for a, b, runs in zip(edges[:-1], edges[1:], found, strict=True):
        assert sorted(i for x, y in runs for i in range(x, y + 1)) == np.flatnonzero(flags[a:b]).tolist()
        assert all(y + 1 < x for (_, y), (x, _) in zip(runs, runs[1:]))
