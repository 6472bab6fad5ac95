from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsluice.llm import blocks, language_model
from docsluice.llm.bpe import bpe_round_trip, word_bpe
from docsluice.llm.common import TwoGenerationCache, train_flag
from docsluice.llm.decontaminate import approximate_ends, drop_contaminated, find_contamination, item_words
from docsluice.llm.language_id import fit_language_filter, identify_language
from docsluice.llm.language_model import score_documents
from docsluice.llm.sharding import fisher_yates, shuffle_into_shards
from docsluice.llm.token_counts import allocate, count_tokens_by_line, line_edges
from docsluice.llm.token_files import EliasFano, TokenFile, digest_token_files, pack_file, read_token_files, write_token_files
from docsluice.llm.topk import BlockIndex, top_k

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
ODD = ["", " ", "a", "  a  b ", "x <|endoftext|> y", "<|startoftext|>", "I'm HERE's 123 ½ ٣", "é é ǅ İ ΑΣ Σ", "日本語 テスト", "a b c\u0085d", "tab\t \nend\n", "\x1c\x1f x", "it's they'LL", "🙂🙂 ok", "á ́b", "5abc, (x) y.", "end ", "﻿mark"]


def test_cache_is_bounded():
    cache = TwoGenerationCache(10)
    for k in range(100):
        for x in cache.unknown([k, k + 1]):
            cache.young[x] = x
        assert len(cache.young) <= 11 and len(cache.old) <= 11


def test_bpe_equals_the_library(docs, rows):
    library, texts = Tokenizer.from_file(WORD), [r[1] or "" for r in rows] + ODD
    model = word_bpe(open(WORD, "rb").read())
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids
        assert model.encode_and_decode(text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
    got = sorted(map(tuple, bpe_round_trip(docs, WORD).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    assert got == sorted(((r[0], len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for r, i in zip(rows, ids, strict=True)), key=str)


def test_bpe_can_keep_texts(docs, empty, crowded):
    row = bpe_round_trip(docs.where("doc_id = 5"), WORD, keep_texts=True).first()
    assert len(row["ids"]) == row["n_tokens"] and row["decoded"].startswith(row["decoded"].split(" ")[0])
    assert bpe_round_trip(empty, WORD).count() == 0 and bpe_round_trip(crowded, WORD).count() == crowded.count()


@pytest.mark.parametrize(("n", "universe"), [(0, 1), (1, 1), (1, 10**12), (700, 701), (1000, 5), (3000, 10**9)])
def test_elias_fano(n, universe):
    values = np.sort(np.random.default_rng(n).integers(0, universe, n)).astype(np.uint64)
    code = EliasFano.build(values, universe)
    assert code.values().tolist() == values.tolist()
    assert [code.select(i) for i in range(n)] == values.tolist()
    assert 8 * (len(code.low) + len(code.high)) <= n * (3 + max(0, math.log2(universe / max(n, 1)))) + 80
    with pytest.raises(IndexError):
        code.select(n)


def test_token_file_round_trip():
    lengths = [1, 5, 1, 300]
    ids = np.arange(sum(lengths), dtype="<u2")
    file = TokenFile(pack_file([3, None, -1, 2**40], lengths, ids.tobytes(), 2))
    assert file.doc_ids == [3, None, -1, 2**40] and [file.span(i)[1] - file.span(i)[0] for i in range(4)] == lengths
    assert np.concatenate([file.document(i) for i in range(4)]).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        TokenFile(b"x" * 100)


def test_token_files(docs, rows, spark, empty):
    library = Tokenizer.from_file(BYTE)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    manifest = write_token_files(more, BYTE, public_tokenizers.PATTERN)
    got = sorted((tuple(r) for r in digest_token_files(manifest).collect()), key=lambda r: r[1])
    whole = [(r[0], r[1] or "") for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    ids = {(d, t): [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in whole}
    assert [r[0] for r in got] == sorted((d for d, _ in whole), key=lambda x: (x is not None, x or 0))
    assert [r[1] for r in got] == (np.cumsum([r[2] for r in got]) - [r[2] for r in got]).tolist()
    crc = Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in whole for x in [ids[d, t]])
    assert Counter((r[0], r[2], r[3]) for r in got) == crc
    read = {r["doc_id"]: r["ids"] for r in read_token_files(manifest).collect()}
    assert read[1006] == ids[1006, ODD[6]]
    assert digest_token_files(write_token_files(empty, BYTE, public_tokenizers.PATTERN)).count() == 0


def test_token_counts(docs, rows, spark, empty):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    more = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    lines = Counter()
    for doc, text in [(r[0], r[1] or "") for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]:
        spans = library.encode(text, add_special_tokens=False).offsets
        first = 0
        for i, line in enumerate(text.splitlines(keepends=True) if "\n" in text and not set(text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") else re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]):
            lines[doc, i, first, first + len(line), sum(first <= a < first + len(line) for a, _ in spans)] += 1
            first += len(line)
    plain = {d for d in [r[0] for r in rows] + [1000 + i for i in range(len(ODD))]} - {1000 + i for i, t in enumerate(ODD) if any(len(c.encode()) > 2 for c in t)}
    got = Counter(tuple(r) for r in count_tokens_by_line(more, RANKS, public_tokenizers.PATTERN).select("doc_id", "section", "start_char", "end_char", "n_tokens").collect())
    of_plain = lambda c: {k: n for k, n in c.items() if k[0] in plain}
    assert of_plain(got) == of_plain(lines) and {k[:4] for k in got} == {k[:4] for k in lines}
    for row in count_tokens_by_line(more, RANKS, public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("n_tokens"), F.max("doc_tokens"), F.max("end_char"), F.max("section")).collect():
        texts = [t or "" for d, t in [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)] if d == row[0]]
        n = len(library.encode(texts[0], add_special_tokens=False).ids)
        assert (row[1], row[2], row[3]) == (n * len(texts), n, len(texts[0]))
        assert row[4] == max(0, len(texts[0].split("\n")) - 1 - texts[0].endswith("\n"))
    assert count_tokens_by_line(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_allocation_rules():
    ends, edges = np.array([2, 7, 8]), np.array([3, 6, 8])  # the token 2 to 7 has 1, 3 and 1 bytes of the sections
    assert allocate(ends, edges, "start").tolist() == [2, 0, 1]
    assert allocate(ends, edges, "end").tolist() == [1, 0, 2]
    assert allocate(ends, edges, "most").tolist() == [1, 1, 1]
    assert allocate(ends, edges, "split").tolist() == pytest.approx([1.2, 0.6, 1.2])
    assert line_edges(b"a\n\nb").tolist() == [2, 3, 4] and line_edges(b"a\n").tolist() == [2] and line_edges(b"").tolist() == [0]
    with pytest.raises(ValueError):
        allocate(ends, edges, "other")


def sellers(pattern, text):
    """Least edits of the pattern to a part of the text, for each end."""
    column = list(range(len(pattern) + 1))
    for end, x in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(column[i - 1] + (p != x), column[i] + 1, new[i - 1] + 1))
        column = new
        yield end, column[-1]


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        pattern, text = [rng.randrange(3) for _ in range(rng.randrange(1, 90))], [rng.randrange(3) for _ in range(60)]
        k = rng.randrange(len(pattern) + 1)
        assert approximate_ends(pattern, text, k) == [(e, d) for e, d in sellers(pattern, text) if d <= k]


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    write = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(write(rng.randrange(1, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, " ... "), (93, "W1, w2"), (94, "w1 w2")]
    docs = []
    for d in range(40):
        text = write(60)
        item = rng.choice(items[:25])[1].split()
        for _ in range(rng.randrange(8)):
            j = rng.randrange(len(item))
            item[j : j + 1] = rng.choice([[], [rng.choice(words)], [item[j], "new"]])
            item = item or ["w0"]
        docs.append((d, " ".join(text[:20] + item + text[20:]).upper()))
    docs += [(50, None), (51, ""), (0, docs[0][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = Counter()
    for d, t in docs:
        for i, x in items:
            p, w = item_words(x or ""), item_words(t or "")
            best = min((n for _, n in sellers(p, w)), default=99) if p else 99
            if best <= int(0.2 * len(p)):
                expected[d, i, best, len(p)] += 1
    got = Counter((r["doc_id"], r["item_id"], r["distance"], r["item_words"]) for r in find_contamination(df, bench).collect())
    assert got == expected
    assert got == Counter((r["doc_id"], r["item_id"], r["distance"], r["item_words"]) for r in find_contamination(df, bench, index_bytes=500).collect())
    dirty = {d for d, *_ in expected}
    assert sorted(r["doc_id"] for r in drop_contaminated(df, bench).collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_repeated_items_stay_repeated(spark):
    items = [(1, "one two three four five six")] * 300 + [(1, "seven eight nine"), (2, "one two three four five six"), (None, "seven eight nine"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    df = spark.createDataFrame([(7, "so one two three four five six seven eight nine"), (8, "nothing"), (None, "seven eight nine")], "doc_id long, text string")
    want = Counter({(7, 1, 0, 6): 300, (7, 1, 0, 3): 1, (7, 2, 0, 6): 1, (7, None, 0, 3): 1, (None, 1, 0, 3): 1, (None, None, 0, 3): 1})
    for index_bytes in (1 << 20, 40):
        assert Counter((r["doc_id"], r["item_id"], r["distance"], r["item_words"]) for r in find_contamination(df, bench, index_bytes=index_bytes).collect()) == want
        assert [r["doc_id"] for r in drop_contaminated(df, bench, index_bytes=index_bytes).collect()] == [8]


def test_no_items_or_documents(docs, empty, spark, crowded):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, none).count() == 0 and drop_contaminated(docs, none).count() == docs.count()
    assert drop_contaminated(empty, none).count() == 0 and drop_contaminated(crowded, none).columns == crowded.columns


def test_language_id(spark, docs, empty, crowded):
    rng = random.Random(2)
    letters = {"aa": "abcdei", "bb": "ouxyzé"}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i in range(200) for lang in ("aa", "bb")]
    df = spark.createDataFrame([(i, t, lang) for i, (_, t, lang) in enumerate(rows)] + [(900, None, "aa"), (901, "12 !!", "bb"), (902, "", None), (903, text("aa", 5), None), (903, text("bb", 5000), None)], "doc_id long, text string, lang string")
    model = fit_language_filter(df, train_flag(F.col("doc_id"), 4, 2))
    out = identify_language(df, model).collect()
    held = [r for r in out if r["lang"] and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (900, 901, 902)) and all(0 <= r["score"] <= 1 for r in out)
    assert sorted(r["lang_pred"] for r in out if r["doc_id"] == 903) == ["aa", "bb"]
    unlearned = fit_language_filter(empty)
    assert {r["lang_pred"] for r in identify_language(docs, unlearned).collect()} == {"und"} and identify_language(empty, model).count() == 0
    assert identify_language(crowded, model).count() == crowded.count()


def test_language_id_of_many_languages(spark):
    rng = random.Random(6)
    langs = {f"l{i:03}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for i in range(130)}
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60)), lang) for i, (lang, letters) in enumerate(x for x in langs.items() for _ in range(6))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = fit_language_filter(df)
    assert model.languages == sorted(langs) and model.masks.shape[0] == 3
    out = identify_language(df, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert {r["lang_pred"] for r in out} >= {"l000", "l063", "l064", "l128", "l129"}


def brute_tree(rows, train):
    """The suffix tree, in dicts."""
    seqs = [[b"", *(r[1] or "").encode().lower().split(), b""] for r in rows]
    c = Counter(w for s, t in zip(seqs, train, strict=True) if t for w in s[1:])
    n, v = sum(c.values()), len(c)
    least, gain = language_model.LEAST_COUNT, language_model.LEAST_GAIN * 1000
    base = lambda w: (c[w] + 1) / (n + v + 1)
    p2, p3 = Counter(), Counter()
    for s, t in zip(seqs, train, strict=True):
        if t:
            p2.update((u, w) for u, w in zip(s, s[1:]) if c[u] >= least)
    for s, t in zip(seqs, train, strict=True):
        if t:
            p3.update((a, u, w) for a, u, w in zip(s, s[1:], s[2:]) if c[u] >= least and p2[a, u] >= least)
    once1, once2 = Counter(u for (u, _), k in p2.items() if k == 1), Counter((a, u) for (a, u, _), k in p3.items() if k == 1)
    nu1, nu2 = (lambda u: (once1[u] + 1) / (c[u] + 2)), (lambda a, u: (once2[a, u] + 1) / (p2[a, u] + 2))
    one = lambda u, w, own=0: (1 - nu1(u)) * (p2[u, w] - own) / (c[u] - own) + nu1(u) * base(w)
    two = lambda a, u, w, own=0: (1 - nu2(a, u)) * (p3[a, u, w] - own) / (p2[a, u] - own) + nu2(a, u) * one(u, w, own)
    g1, g2 = Counter(), Counter()
    for (u, w), k in p2.items():
        g1[u] += k * round(1000 * math.log(one(u, w, 1) / base(w)))
    for (a, u, w), k in p3.items():
        g2[a, u] += k * round(1000 * math.log(two(a, u, w, 1) / one(u, w, 1)))
    out = []
    for s in seqs:
        b = f = 0.0
        for j in range(1, len(s)):
            u, w = s[j - 1], s[j]
            b += math.log10(base(w))
            if j > 1 and g2[s[j - 2], u] > gain:
                f += math.log10(two(s[j - 2], u, w))
            else:
                f += math.log10(one(u, w) if g1[u] > gain else base(w))
        out.append((len(s) - 1, sum(c[w] > 0 for w in s[1:]), n, b, f))
    return out, sum(g > gain for g in g1.values()), sum(g > gain for g in g2.values())


def test_language_model_equals_brute_force(spark, empty):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    phrase = " ".join(f"p{i}" for i in range(12)) + " p3 q " + " ".join(f"r{i}" for i in range(5))
    rows = [(i, " ".join([*rng.choices(words, k=rng.randrange(60)), *([phrase] if i % 2 else []), *rng.choices(words, k=5)])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "Never seen\tbefore"), (203, rows[1][1]), (203, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    flag = train_flag(F.col("doc_id"), 7, 2)
    train = [zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    expected, short, long = brute_tree(rows, train)
    assert short and long
    key = lambda r: (r[0], r[4])
    got = sorted(((r["doc_id"], not r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["train_tokens"]) for r in score_documents(df, flag).collect()), key=key)
    want = sorted(((r[0], t, e[0], e[1], e[3], e[4], e[2]) for r, t, e in zip(rows, train, expected, strict=True)), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[6] == b[6] and a[4:6] == pytest.approx(b[4:6], abs=1e-6)
    held = [x for x in got if not x[1]]
    assert sum(x[5] for x in held) > sum(x[4] for x in held)
    assert score_documents(empty, F.lit(True)).count() == 0
    assert {r["score"] for r in score_documents(df, F.lit(False)).collect()} == {0.0}


def brute_any_length(rows, train, least=2, gain=12.0):
    """Held-in and held-out scores of the suffix tree without a bound on its contexts, and the kept contexts."""
    seqs = [[b"", *r[1].encode().lower().split(), b""] for r in rows]
    c = Counter(w for s, t in zip(seqs, train, strict=True) if t for w in s[1:])
    base = {w: (c[w] + 1) / (sum(c.values()) + len(c) + 1) for s in seqs for w in s}
    after = {}
    for s, t in zip(seqs, train, strict=True):
        for j in range(1, len(s)):
            for m in range(1, j + 1):
                after.setdefault(tuple(s[j - m : j]), Counter())[s[j]] += t

    def share(x, w, own=0):
        if not x:
            return base[w]
        n, new = sum(after[x].values()), (sum(k == 1 for k in after[x].values()) + 1) / (sum(after[x].values()) + 2)
        return (1 - new) * max(after[x][w] - own, 0) / max(n - own, 1) + new * share(x[1:], w, own)

    kept = set()
    for x in sorted(after, key=len):
        if sum(after[x].values()) >= least and (len(x) < 3 or x[1:] in kept):
            if sum(k * round(1000 * math.log(share(x, w, 1) / share(x[1:], w, 1))) for w, k in after[x].items() if k) > gain * 1000:
                kept.add(x)
    state = lambda x: x if not x or x in kept else state(x[1:])
    return [sum(math.log10(share(state(tuple(s[max(0, j - 6) : j])), s[j])) for j in range(1, len(s))) for s in seqs], kept


def test_rare_and_long_contexts_are_kept(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROW_TEXT", 1 << 30)  # by two steps; the other tests take one
    rng = random.Random(5)
    rows = []
    for i in range(400):
        one, two, by = rng.choice("xyz"), rng.choice("gh"), rng.choice(["and", "then", "or"])
        said = {"and": f"{one}{two}", "then": two, "or": "k"}[by]
        rows.append((i, f"w{rng.randrange(99)} {one} {two} {by} so {said} " + ("once upon midnight " if i % 20 == 0 else "") + f"w{rng.randrange(99)}"))
    df, flag = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), train_flag(F.col("doc_id"), 7, 2)
    want, kept = brute_any_length(rows, [zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows])
    assert (b"upon",) in kept and max(map(len, kept)) >= 4
    got = {r["doc_id"]: r["score"] for r in score_documents(df, flag).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=1e-6)


def test_clashing_columns_of_the_model(crowded):
    assert score_documents(crowded, F.lit(True)).count() == crowded.count()


def brute_top(rows, k):
    import math as m

    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and m.isfinite(x) for x in v):
            usable.setdefault(i, []).append([m.floor(256 * float(np.float32(x))) for x in v])
    flat = [(i, v) for i, vs in usable.items() for v in vs]
    out = set()
    for i, vs in usable.items():
        if i % 50 == 0:
            for q in {tuple(v) for v in vs}:
                best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in flat if j != i)[:k]
                out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("shard_rows", [20_000, 30])
def test_top_k_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(160)]
    rows += [(200 + i, rows[7][1]) for i in range(8)] + [(300, None), (350, [1.0, None]), (400, [float("nan")]), (450, [float("inf"), 0.0]), (None, [1.0]), (500, []), (501, [0.5]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, query_rows=2 if shard_rows == 30 else 2000).collect()}
    assert got == brute_top(rows, 5)


def test_top_k_of_few_or_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


def test_blocks_are_passed_over():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(40, 8)) * 100, 50, axis=0).round() + rng.integers(-2, 3, (2000, 8))
    index = BlockIndex(np.arange(2000), x, 50)
    ids, scores = index.search(-1, x[3], index.bounds(x[3:4])[0], 5)
    every = x @ x[3]
    assert scores.tolist() == sorted(every, reverse=True)[:5] and index.scored < 1500


def test_fisher_yates_is_uniform():
    assert sorted(fisher_yates(100, [1, 2]).tolist()) == list(range(100)) and fisher_yates(0, 1).tolist() == [] and fisher_yates(1, 1).tolist() == [0]
    seen = Counter(tuple(fisher_yates(3, [7, s])) for s in range(1200))
    assert len(seen) == 6 and min(seen.values()) > 140


@pytest.mark.parametrize("bucket_bytes", [24 << 20, 2000])
def test_sharding(docs, rows, spark, bucket_bytes, tmp_path):
    out = shuffle_into_shards(docs, f"file://{tmp_path}/s", shards=4, bucket_bytes=bucket_bytes)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    count = Counter(r["shard"] for r in got)
    assert set(count) == set(range(4)) and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in count.items())
    again = shuffle_into_shards(docs, f"file://{tmp_path}/t", shards=4, bucket_bytes=bucket_bytes).collect()
    assert {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in again}


def test_sharding_of_repeated_rows(spark, empty, crowded):
    same = spark.createDataFrame([(1, "x")] * 300, "doc_id long, text string").repartition(4)
    out = shuffle_into_shards(same, shards=16, bucket_bytes=60)
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [18] * 4 + [19] * 12
    assert shuffle_into_shards(empty).count() == 0
    assert set(shuffle_into_shards(crowded).columns) == set(crowded.columns)
    dotted = same.withColumns({"a.b": F.lit(1), "row": F.lit(2), "c1": F.lit(3), "tag": F.lit(4)})
    assert [r["count"] for r in shuffle_into_shards(dotted, shards=2, bucket_bytes=60).select("`a.b`", "row", "c1", "tag").groupBy("`a.b`", "row", "c1", "tag").count().collect()] == [300]


def test_equal_rows_fill_no_bucket(spark):
    from docsluice.llm import sharding

    same = spark.range(200_000, numPartitions=4).select(F.lit("the same").alias("text"))
    rows = shuffle_into_shards(same, shards=4, bucket_bytes=90_000)
    files = rows.groupBy(F.input_file_name()).count().collect()  # a bucket writes a file into each shard that it reaches
    assert len(files) >= 20 and max(r["count"] for r in files) < 12_000 and sharding.SHARDS == 16
