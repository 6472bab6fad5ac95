"""Line dedup, the Merkle manifest and fill-in-middle against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docsluice.llm.fill_middle import fill_in_middle, middle_digests, restored
from docsluice.llm.line_dedup import drop_common_lines, line_digests
from docsluice.llm.merkle import leaf_digest, merkle_manifest
from docsluice.llm.queries import LEAF_FIELDS, UPPER

LINES = "doc_id long, text string"
CASES = [
    (3, "One shared line, long\nown to 3\n\n  ONE shared line, long\x0b"),
    (1, "short\n one SHARED line, long\r\nown to 1 and nobody else"),
    (2, "short\nÉtat partagé ici\n"),
    (5, "short\nétat partagé ici\nÉTAT PARTAGÉ ICI"),
    (4, " one shared line, long\none shared line, long"),
    (7, None),
    (8, ""),
    (None, "one shared line, long\nonly where no id is\nx"),
    (None, "only where no id is"),
    (9, "exactly10!\nnine char"),
    (10, "exactly10!\nnine char"),
    (10, "exactly10!\nnine char"),
    (11, "\n".join(f"line number {i % 400} of many" for i in range(4000))),
    (12, "\n".join(f"line number {i} of many" for i in range(0, 800, 2))),
]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
ordered = lambda rows: sorted(map(tuple, rows), key=str)


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    after = lambda i: (i is None, i or 0)
    first = {}
    for i, text in rows:
        for k in map(key, (text or "").split("\n")):
            first[k] = min(first.get(k, (True, 1)), after(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == after(i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out




def test_lines_equal_brute_force(spark, rows):
    for data in (CASES, [(r[0], r[1]) for r in rows]):
        got = line_digests(spark.createDataFrame(data, LINES).repartition(3))
        assert ordered(got.collect()) == ordered(brute_lines(data))


def test_lines_keep_other_columns(spark, empty):
    data = [(i, x, i, 7, "w") for i, x in CASES]
    df = spark.createDataFrame(data, "doc_id long, text string, `a.b` long, n_lines long, `hash` string")
    out = drop_common_lines(df)
    assert out.columns == ["doc_id", "text", "a.b", "hash", "n_lines", "n_dropped"]
    assert {(r["doc_id"], r["a.b"], r["hash"]) for r in out.collect()} == {(i, i, "w") for i, _ in CASES}
    assert {r["text"] for r in out.where("doc_id = 7").collect()} == {None}
    assert drop_common_lines(empty).count() == 0 and line_digests(empty).count() == 0


def test_lines_by_threshold(spark):
    df = spark.createDataFrame([(1, "in two of them\nin three of them"), (2, "in two of them\nin three of them"), (3, "in three of them\nin three of them")], LINES)
    out = drop_common_lines(df, least_documents=3, keep_first=False)
    assert ordered(out.select("doc_id", "text", "n_dropped").collect()) == [(1, "in two of them", 1), (2, "in two of them", 1), (3, "", 2)]


def test_lines_of_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a line that is shared"), (2, "a line that is shared")], "`my.id` long, `the text` string")
    assert ordered(drop_common_lines(df, id_col="my.id", text_col="the text").select("n_dropped").collect()) == [(0,), (1,)]


def brute_tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def brute_manifest(data, fanout):
    kv = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(kv(x) for x in (r[0], r[3], r[2], r[4], r[1])))
    low = lambda x: None if x is None else "".join(c.lower() if c.isascii() else c for c in x)
    by = {}
    for r in data:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fanout) for s in names}
    top, out = brute_tree([trees[s][-1][0] for s in names], fanout), []
    for j, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            held = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now, proof = leaf((r[0], low(r[1]), *r[2:])) if held else own, []
            for at, levels in ((i, trees[s]), (j, top)):
                for nodes in levels[:-1]:
                    run = nodes[at // fanout * fanout : at // fanout * fanout + fanout]
                    proof += run[: at % fanout] + run[at % fanout + 1 :]
                    now, at = sha("".join(run[: at % fanout] + [now] + run[at % fanout + 1 :])), at // fanout
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha("".join(proof)), now, now == top[-1][0]))
    return out


def tree_rows():
    """Sources of 1 to 90 rows, a null one, null and repeated ids, repeated rows, nulls in every column."""
    out = []
    for s, n in [("a", 90), ("é", 16), ("z", 17), ("", 3), (None, 5), ("Z", 1)] + [(f"s{i}", 1 + i % 2) for i in range(20)]:
        out += [(1000 * len(out) + 7 * i, f"Text {i} of {s}" if i % 4 else None, "en" if i % 3 else None, s, i if i % 5 else None) for i in range(n)]
    return [*out, (None, "No Id", "en", "a", 1), (None, None, None, None, None), out[3], out[3], (out[3][0], "Other Text", "en", "a", 2), (5, "", "", "a", 0), (6, "Ab" * 300_000, "en", "a", 1)]


@pytest.mark.parametrize(("fanout", "levels"), [(16, 3), (3, 2)])
def test_manifest_equals_brute_force(spark, fanout, levels):
    df = spark.createDataFrame(tree_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    tampered = leaf_digest(*map(F.col, LEAF_FIELDS[:-1]), F.translate("text", UPPER, UPPER.lower()))
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    got = merkle_manifest(df, LEAF_FIELDS, claimed=claimed, fanout=fanout, levels=levels)
    wanted = ordered(brute_manifest(tree_rows(), fanout))
    assert ordered(got.collect()) == wanted and {r[-1] for r in wanted} == {True, False}


def test_manifest_of_few_rows(spark, empty, crowded):
    assert merkle_manifest(empty, LEAF_FIELDS).count() == 0
    row = merkle_manifest(spark.createDataFrame([(1, "x")], "`an.id` long, grp string"), ["an.id", "grp"], id_col="an.id", group_col="grp", with_siblings=True).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == sha("1:11:x") and row["proof_sha256"] == sha("") and row["siblings"] == []
    told = merkle_manifest(crowded, LEAF_FIELDS, with_siblings=True)
    assert told.count() == crowded.count() and told.where("NOT verified").count() == 0
    assert all(sha("".join(r["siblings"])) == r["proof_sha256"] for r in told.collect())


TEXTS = ["", "a", "ab", "🙂é\n日本", "has <S> in it", "<M>", "<P", "P>", "<S" * 40, "line\r\nline x", "x" * 5000, "word " * 3000]


def brute_middle(i, text):
    text = text or ""
    d = sha(f"1:{'' if i is None else i}")
    h, n = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (i, n, form, a, b - a, sha(out), sha(text))


def test_middles_equal_brute_force(spark, rows):
    data = [(i, TEXTS[i % len(TEXTS)]) for i in range(600)] + [(None, "no id"), (700, None), (3, TEXTS[3])] + [(r[0], r[1]) for r in rows]
    got = middle_digests(spark.createDataFrame(data, LINES).repartition(3)).collect()
    assert ordered(got) == ordered(brute_middle(*x) for x in data)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_middles_by_words_and_other_sentinels(spark, empty, crowded):
    text, marks = " two  words and\tmore \n", ("[PRE]", "[SUF]", "[MID]")
    df = spark.createDataFrame([(i, text, 1) for i in range(80)], "`the.id` long, text string, output long")
    out = fill_in_middle(df, id_col="the.id", unit=r"\S+\s*|\s+", sentinels=marks).withColumn("back", restored(F.col("output"), F.col("form"), marks))
    assert out.columns == ["the.id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    told = out.collect()
    assert {r["back"] for r in told} == {text} and {r["n"] for r in told} == {5} and {r["form"] for r in told} == {"plain", "psm", "spm"}
    for r in (r for r in told if r["form"] == "psm"):
        prefix, suffix, middle = re.fullmatch(r"(?s)\[PRE\](.*)\[SUF\](.*)\[MID\](.*)", r["output"]).groups()
        assert prefix + middle + suffix == text and not re.search(r"\w$", prefix) and len(middle) == r["middle_chars"]
    # a unit that leaves something out: such texts stay plain
    assert {r["form"] for r in fill_in_middle(df, id_col="the.id", unit=r"\w+").collect()} == {"plain"}
    assert fill_in_middle(empty).count() == 0 and fill_in_middle(crowded).count() == crowded.count()
