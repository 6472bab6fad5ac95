"""Language ID against plain Python, and column names of any kind through all stages."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsluice.llm import language_id
from docsluice.llm.common import Scratch, train_flag
from docsluice.llm.decontaminate import find_contamination
from docsluice.llm.language_id import fit_language_filter, identify_language
from docsluice.llm.token_counts import count_tokens_by_line
from docsluice.llm.topk import top_k

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def grams(text, n):
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {w} "
        yield from (padded[i : i + n] for i in range(len(padded) - n + 1))


def slots(gram, size):
    h, full = len(gram), (1 << 64) - 1
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & full
        h ^= h >> 29
    return [h + i * (h >> 32 | 1) & size - 1 for i in range(language_id.HASHES)]


def test_language_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LEAST_SHARE", 5e-6)
    rng = random.Random(3)
    own = {"aa": "abcdeé", "bb": "xyzabw", "cc": "mnoüpq"}
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(1, 6)))
    rows = [(i, " ".join(word(own[lang]) for _ in range(rng.randrange(0, 30))), lang if i % 9 else None) for i, lang in enumerate(rng.choices(sorted(own), k=240))]
    rows += [(500, None, "aa"), (501, "12 34 ..", "bb"), (502, "Abc" * 30_000, "aa"), (None, "abc abd", "aa"), rows[4], rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    train = train_flag(F.col("doc_id"), 4, 2)
    model = fit_language_filter(df, train, least_share=1e-3)
    learned = {(r["doc_id"], r["text"], r["lang"]): r["t"] for r in df.select("*", train.alias("t")).collect()}
    counts = {(lang, n): Counter() for lang in own for n in language_id.SIZES}
    for i, text, lang in rows:
        if lang and learned[i, text, lang]:
            for n in language_id.SIZES:
                counts[lang, n].update(grams(text, n))
    has = {lang: {g for n in language_id.SIZES for g, c in counts[lang, n].items() if c >= max(2, sum(counts[lang, n].values()) * 1e-3)} for lang in own}
    size = model.masks.shape[1]
    assert model.languages == sorted(own) and size == 1 << max(10, math.ceil(math.log2(max(map(len, has.values())) * language_id.HASHES / language_id.FILL)))
    set_bits = {lang: {at for g in has[lang] for at in slots(g, size)} for lang in own}
    for bit, lang in enumerate(model.languages):
        assert set(np.flatnonzero(model.masks[0] >> np.uint64(bit) & np.uint64(1)).tolist()) == set_bits[lang]
    told = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in identify_language(df, model).collect()}
    for i, text, _ in rows:
        all_grams = [g for n in language_id.SIZES for g in grams(text, n)]
        if not all_grams:
            assert told[i, text] == ("und", 0.0)
            continue
        at = {g: slots(g, size) for g in set(all_grams)}
        shares = []
        for lang in model.languages:
            chance = (len(set_bits[lang]) / size) ** language_id.HASHES
            hits = sum(all(x in set_bits[lang] for x in at[g]) for g in all_grams)
            assert hits >= sum(g in has[lang] for g in all_grams)  # none is missed
            shares.append((hits / len(all_grams) - chance) / (1 - chance))
        best = max(range(len(shares)), key=lambda j: (shares[j], -j))
        assert told[i, text][0] == model.languages[best] and told[i, text][1] == pytest.approx(min(1, max(0, shares[best])))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_take_columns_of_any_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", F.col("doc_id").alias("a.b"), F.lit("x").alias("my col"), F.lit(1).alias("_"), F.lit("y").alias("c0"), F.lit(2).alias("lang_pred"), F.lit("z").alias("`q`"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = Scratch(spark).saved(stage(spark, now, DATA), name)
        assert now.columns == docs.columns and {(r["a.b"] == r["doc_id"], r["my col"], r["c0"]) for r in now.collect()} == {(True, "x", "y")}
    out = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert out.count() == now.count() > 0


def test_ids_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five", 3)], "`end_word` long, `the.text` string, distance int")
    items = spark.createDataFrame([(7, "two three four")], "end_word long, text string")
    found = find_contamination(docs, items, id_col="end_word", text_col="the.text", item_col="end_word")
    assert found.columns == ["end_word_id", "end_word_id_id", "distance", "item_words", "end_word"] and tuple(found.first()) == (1, 7, 0, 3, 4)
    import public_tokenizers

    told = count_tokens_by_line(docs.withColumnRenamed("end_word", "section"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, id_col="section", text_col="the.text")
    assert told.columns[:2] == ["section_id", "section"] and told.first()["section_id"] == 1
    vectors = spark.createDataFrame([("1", [1.0, 2.0], 1), ("2", [2.0, 1.0], 2), ("x", [9.0, 9.0], 3), (None, [9.0, 9.0], 4)], "`v.id` string, `v.v` array<double>, rank int")
    best = top_k(vectors, F.col("rank") == 1, id_col="v.id", vector_col="v.v")
    assert [tuple(r) for r in best.collect()] == [(1, 1, 2, 256 * 256 * 4)]
    with pytest.raises(ValueError):
        top_k(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>"), F.lit(True))
