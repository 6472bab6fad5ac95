from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsluice.llm.common import Scratch
from docsluice.llm.components import components
from docsluice.llm import blocks, suffix_dedup
from docsluice.llm.set_join import SkipJoin, one_of_each_group, similar_groups
from docsluice.llm.sharding import shuffle_into_shards
from docsluice.llm.suffix_dedup import anchors, drop_repeats, factors_at, factors_in_large, longest_previous_factors, previous_factors, repeat_digests, suffix_array


@pytest.mark.parametrize("text", [b"", b"a", b"aaaaaaaaaaaaaaaaaaaa", b"banana", b"abcabcabcx\0\0abc", bytes(random.Random(2).choices(b"ab", k=300))])
def test_suffix_array_and_factors(text):
    n = len(text)
    assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:])

    def longest(i):
        return max([0, *(next((k for k in range(n - i) if text[j + k] != text[i + k]), n - i) for j in range(i))])

    assert longest_previous_factors(text).tolist() == [longest(i) for i in range(n)]


def test_previous_factors_by_the_stack():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 300):
        for places in (rng.permutation(n), np.arange(n), np.arange(n)[::-1], np.concatenate((np.arange(n // 2, n), np.arange(n // 2)))):
            common = np.append(0, rng.integers(0, 4, n - 1))
            want = [max([0, *(min(common[min(i, j) + 1 : max(i, j) + 1]) for j in range(n) if places[j] < places[i])]) for i in range(n)]
            assert previous_factors(places, common).tolist() == want


def pieces_of(least):
    rng = random.Random(least)
    base = bytes(rng.choices(b"abcd", k=1500))
    return [base, base[100:900], base[:600], base[30 : 30 + least]]


@pytest.mark.parametrize("lengths", [[8], [24], [100, 101], [200, 400], [130, 256, 513]])
def test_factors_at(lengths):
    texts = pieces_of(lengths[0])
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts = np.concatenate([np.arange(a, a + len(t) - lengths[0] + 1) for a, t in zip(edges, texts)])
    room = np.concatenate([np.arange(len(t), lengths[0] - 1, -1) for t in texts])
    windows = [[t[i : i + n] for t in texts for i in range(len(t) - lengths[0] + 1)] for n in lengths]
    want_earlier, want_other = [0] * len(starts), [0] * len(starts)
    for n, these in zip(lengths, windows, strict=True):
        every, seen = Counter(w for w in these if len(w) == n), Counter()
        for i, w in enumerate(these):
            if len(w) == n:
                want_earlier[i] = n if seen[w] else want_earlier[i]
                want_other[i] = n if every[w] > 1 else want_other[i]
                seen[w] += 1
    for got in (factors_at(np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8), starts, room, lengths), factors_in_large(texts, np.array([len(t) - lengths[0] + 1 for t in texts]), lengths)):
        assert got[0].tolist() == want_earlier and got[1].tolist() == want_other


def test_large_groups_give_the_same():
    base = pieces_of(5)[0]
    texts = [base, base[100:900], base[:600], *(base[600:1200] + bytes([65 + i % 50]) * (i + 1) for i in range(300))]
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for least in (130, 200, 513):
        starts = np.concatenate([np.arange(a, a + len(t) - least + 1) for a, t in zip(edges, texts)])
        room = np.concatenate([np.arange(len(t), least - 1, -1) for t in texts])
        small = factors_at(np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8), starts, room, [least])
        for a, b in zip(small, factors_in_large(texts, np.array([len(t) - least + 1 for t in texts]), [least]), strict=True):
            assert a.tolist() == b.tolist()


def test_windows_whose_hashes_meet_are_told_apart(monkeypatch):
    true = suffix_dedup.window_hashes
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda *x: true(*x) & np.uint64(15))
    test_large_groups_give_the_same()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 101, 2000).astype(np.uint8)
    a, b = anchors(base, np.array([2000]), 200), anchors(base[300:1500], np.array([1200]), 200)
    at = {s: (int(h), int(p)) for h, p, x, y in zip(*b, strict=True) for s in range(x, y + 1)}
    whole = {s: (int(h), int(p)) for h, p, x, y in zip(*a, strict=True) for s in range(x, y + 1)}
    assert len(at) == 1001 and all(whole[s + 300] == (h, p + 300) for s, (h, p) in at.items())


def removed(texts: list[bytes], least: int) -> list[np.ndarray]:
    count = Counter(t[p : p + least] for t in texts for p in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - least + 1):
            if count[t[p : p + least]] > 1:
                gone[p : p + least] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("least", "note", "hot"), [(130, None, 20_000), (400, 256, 20_000), (400, 200, 2)])
def test_digests_equal_brute_force(docs, rows, least, note, hot):
    got = sorted((tuple(r) for r in repeat_digests(docs, least=least, note=note, hot=hot).collect()), key=str)
    texts = [(r[1] or "").encode() for r in rows]
    expected = []
    noted = removed(texts, note) if note else [None] * len(rows)
    for r, t, gone, told in zip(rows, texts, removed(texts, least), noted, strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        expected.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *([int(told.sum())] if note else [])))
    assert got == sorted(expected, key=str)


def test_settling_in_one_process(monkeypatch):
    """Many stretches of one anchor: by suffix order, and beyond 2 * PIECE bytes by confirmed hashes."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 2000)
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdef ", k=500))
    texts = [("".join(rng.choices("ghi ", k=60)) + passage[rng.randrange(90) : 500 - rng.randrange(90)] + "".join(rng.choices("xyz ", k=60))).encode() for _ in range(40)]
    from docsluice.llm.blocks import Keyed

    keyed, lengths = Keyed(64, 2), [150, 400]
    block = suffix_dedup.pa.table({"block": [7], "doc_ids": [list(range(40))], "ends": [np.cumsum([len(t) for t in texts]).astype("<i8").tobytes()], "data": [b"".join(texts)]})
    found = anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), 150)
    kinds, place, count = np.unique(found[0], return_inverse=True, return_counts=True)
    sent = suffix_dedup._stretches(block, found, count[place], keyed, lengths, 10**9, False)
    settling = suffix_dedup._Settling(keyed, lengths, False)
    covered = [np.zeros(sum(map(len, texts)), bool) for _ in lengths]
    for part in {r[0] for r in sent}:
        rows = suffix_dedup.table_of("part long, block long, payload binary, grp long", [(*r, 0) for r in sent if r[0] == part])
        up = settling.gather(rows).to_pylist()
        down = [x for b in {u["bucket"] for u in up} for x in settling.settle(suffix_dedup.table_of(suffix_dedup.UP, [tuple(u.values()) for u in up if u["bucket"] == b])).to_pylist()]
        for row in settling.deal(rows, suffix_dedup.table_of(suffix_dedup.DOWN, [tuple(d.values()) for d in down])).to_pylist():
            left = memoryview(row["payload"])
            for mask, length in zip(covered, lengths):
                a, left = suffix_dedup.unpack_ints(left)
                b, left = suffix_dedup.unpack_ints(left)
                for x, y in zip(a.tolist(), b.tolist()):
                    mask[x : y + length] = True
    for mask, length in zip(covered, lengths):
        assert mask.tolist() == np.concatenate(removed(texts, length)).tolist() and mask.any()


def test_periodic_text(spark):
    rows = [(1, "ab" * 400), (2, "x" * 399), (3, "é" * 250)]
    got = {r["doc_id"]: r["n_removed"] for r in repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 800, 2: 0, 3: 500}


def test_first_copies_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    own = [" ".join(word() for _ in range(30)) for _ in range(3)]
    df = spark.createDataFrame([(1, f"{own[0]} {passage}", 1), (2, f"{passage} {own[1]}", 1), (3, own[2], 1), (4, passage, 1), (5, None, None), (6, "", 0)], "doc_id int, text string, n_chars int").coalesce(1)
    out = {r["doc_id"]: r for r in drop_repeats(df, least=200).collect()}
    assert out[1]["text"] == f"{own[0]} {passage}" and out[3]["text"] == own[2]
    assert passage[20:] not in out[2]["text"] and out[2]["text"].endswith(own[1]) and out[2]["n_chars"] == len(out[2]["text"])
    assert 4 not in out and out[5]["text"] is None and out[6]["text"] == ""
    assert drop_repeats(df, least=200).schema == df.schema


def test_the_first_copy_is_by_id(spark):
    rng = random.Random(14)
    passage = "".join(rng.choices("abcdefg ", k=300))
    rows = [(i, f"{i}{passage[: 300 - i]}{i * 7}", float(i), [i]) for i in range(30)] + [(None, passage, None, None), (3, passage, 1.0, [2]), (3, passage, 1.0, [2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, `my col` double, `a.b-c` array<int>").withColumns({"_": F.lit(1), "__null": F.lit("x"), "c0": F.lit(2), "o1": F.lit(3)})
    outs = [sorted(map(str, drop_repeats(df.repartition(n), least=150).collect())) for n in (1, 3, 7)]
    assert outs[0] == outs[1] == outs[2] and "0" + passage + "0" in {r["text"] for r in drop_repeats(df, least=150).collect()}
    assert drop_repeats(df, least=150).dtypes == df.dtypes


def test_a_very_long_text(spark):
    rng = random.Random(15)
    text = "".join(rng.choices("abcdefghij ", k=700_000))
    df = spark.createDataFrame([(1, text), (2, text[500_000:500_900]), (3, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in repeat_digests(df).collect()} == {1: 900, 2: 900, 3: 0}


def sets_of(rows):
    out = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def groups_of(rows):
    sets, up = sets_of(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    low: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(s), low.get(root(i), r[0])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_groups_equal_brute_force(docs, rows):
    got = [tuple(r) for r in similar_groups(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == groups_of(rows)


def test_two_steps_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(blocks, "ROW_TEXT", 1 << 30)
    assert blocks.Keyed(64, 4).inner_bits == 2
    got = [tuple(r) for r in similar_groups(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == groups_of(rows)
    two = sorted(map(str, repeat_digests(docs, note=256).collect()))
    monkeypatch.undo()
    assert blocks.Keyed(64, 4).inner_bits == 0 and two == sorted(map(str, repeat_digests(docs, note=256).collect()))


def test_groups_in_chunks(docs, rows):
    got = [tuple(r) for r in similar_groups(docs, chunk_bytes=3000).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == groups_of(rows)


def test_results_outlive_other_runs(spark, docs):
    """Each run deletes its own files only."""
    held = repeat_digests(docs)
    shards = shuffle_into_shards(docs)
    assert one_of_each_group(shards).count() == one_of_each_group(docs).count()
    assert held.count() == docs.count() and shards.count() == docs.count()
    with Scratch(spark) as scratch:
        similar_groups(docs, scratch=scratch).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("docsluice_")]


def test_chains_and_thresholds(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(9 - k, " ".join(words[k * 2 : k * 2 + 44])) for k in range(8)] + [(20, "one two three four"), (21, "One two\tthree FOUR"), (22, "one two three")]
    got = [tuple(r) for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == groups_of(rows)


def test_skip_join_loses_no_link():
    rng, asked = np.random.default_rng(5), Counter()
    for _ in range(20):
        base = [rng.choice(40, rng.integers(3, 25), replace=False) for _ in range(4)]
        sets = []
        for i in range(30):
            s = set(base[rng.integers(4)].tolist())
            for _ in range(rng.integers(3)):
                s ^= {int(rng.integers(40))}
            own = int(rng.integers(3))
            sets.append((i, len(s) + own, np.array(sorted(s), np.uint64)))
        join, plain = SkipJoin(sets), SkipJoin(sets, derive=False)
        ties = join.run()
        plain.run()
        assert join.compared <= plain.compared and join.compared + join.derived == plain.compared + plain.derived
        asked["derived"] += join.derived
        for i, of in enumerate(join.overlaps):
            assert all(n == len(np.intersect1d(join.sorted[i], join.sorted[j])) for j, n in of.items())
        up = list(range(30))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in ties:
            up[root(a)] = root(b)
        for a, na, sa in sets:
            for b, nb, sb in sets[:a]:
                common = len(np.intersect1d(sa, sb))
                if na and nb and common and 100 * common >= 80 * (na + nb - common):
                    assert root(a) == root(b)
    assert asked["derived"] > 20


def test_one_of_each_group(docs, crowded, rows, empty):
    kept = one_of_each_group(docs)
    expected = {c for _, _, c in groups_of(rows) if c is not None}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(expected)
    assert kept.where("doc_id is null").count() == 1
    assert one_of_each_group(crowded).columns == crowded.columns
    assert one_of_each_group(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (7, 7)] + [(1000 + i, 999) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100: 50, 75: 50} | {1000 + i: 999 for i in range(50)}


def test_empty_tables(empty):
    assert repeat_digests(empty).count() == 0 and drop_repeats(empty).count() == 0 and similar_groups(empty).count() == 0


def test_clashing_columns(crowded, docs):
    assert sorted(map(str, repeat_digests(crowded, least=130).select("doc_id", "n_removed").collect())) == sorted(map(str, repeat_digests(docs, least=130).select("doc_id", "n_removed").collect()))
    assert drop_repeats(crowded).columns == crowded.columns
