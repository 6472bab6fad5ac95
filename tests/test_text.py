from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsluice.functions import text as x
from docsluice.functions.lexical import cover_density, trigrams, word_similarity
from docsluice.functions.vectors import cosine, is_bad, l2_normalize


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_normalize(spark):
    assert one(spark, "  Ａbc   D\tE\n", lambda v: x.normalize(v, unicode_form=True)) == "abc d e"
    assert one(spark, None, x.normalize) == ""


def test_clean_line(spark):
    assert one(spark, "Karbon​ ver­gisi   çok \t boşluk� ", x.clean_line) == "Karbon vergisi çok boşluk"


def test_repair(spark):
    bad = "étude üzerine".encode().decode("latin-1")
    assert one(spark, bad, x.repair_encoding) == "étude üzerine"
    assert one(spark, "plain é", x.repair_encoding) == "plain é"


def test_garbage(spark):
    assert one(spark, "a\u0007b�\n\t\r", x.garbage_count) == 2


def test_words_and_sentences(spark):
    assert one(spark, " a  b\nc ", x.words) == ["a", "b", "c"]
    assert one(spark, "One. Two!  Three? ", x.sentences) == ["One.", "Two!", "Three?"]
    assert one(spark, "  ", x.sentences) == []
    assert one(spark, None, x.sentences) == []


def test_fold(spark):
    assert one(spark, "İsveç ğüşöç é", x.fold_accents) == "Isvec gusoc e"


def test_cover_density_orders_by_occurrences(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), (["b", "x", "a"],)], "t array<string>")
    assert [round(r[0], 6) for r in df.select(cover_density(["a"])(F.col("t"))).collect()] == [0.2, 0.1, 0.1]
    two = [r[0] for r in df.select(cover_density(["a", "b"])(F.col("t"))).collect()]
    assert two[0] == pytest.approx(0.4) and two[1] == 0 and two[2] == pytest.approx(0.1)


def test_word_similarity(spark):
    assert trigrams("ab") == ["  a", " ab", "ab "]
    df = spark.createDataFrame([(["word"],), (["xyz"],)], "t array<string>")
    assert [r[0] for r in df.select(word_similarity("word")(F.col("t"))).collect()] == [1.0, 0.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0]), (None, None)], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1.0)
    assert [r[0] for r in df.select(is_bad(F.col("a"), 2)).collect()] == [False, True, True, True]
    assert df.select(l2_normalize(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])
