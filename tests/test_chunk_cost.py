"""What counting words and cutting windows take."""

import random
import re

from pyspark.sql import functions as F

from docsluice.functions.text import word_count
from docsluice.operators.chunk import windows_of


def test_words_are_counted_without_a_function_for_each(spark):
    texts = ["", " ", "a", " a b \n", " x\ty", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_count(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in rows.collect()} == {t: len(re.findall(r"\S+", t or "")) for t in texts}
    assert "lambda" not in rows._jdf.queryExecution().toString()


def test_windows_have_the_offsets_of_their_texts(spark):
    rng = random.Random(5)
    blank = lambda: rng.choice([" ", "  ", "\n", "  "])
    texts = ["", " \n", *(blank().join(["", *("w" * rng.randrange(1, 5) for _ in range(n)), ""]) for n in (1, 2, 7, 8, 9, 10, 16, 23, 1100, 2100))]
    rows = spark.createDataFrame([(i, 1, 100 * i, t) for i, t in enumerate(texts)], "file_id long, seg_no int, seg_start int, text string")
    seen: dict[int, int] = {}
    for r in windows_of(rows, 8, 2, 3).collect():
        text, at = texts[r["file_id"]], 100 * r["file_id"]
        assert text[r["char_start"] - at : r["char_end"] - at] == r["chunk_text"] == r["chunk_text"].strip()
        assert len(r["chunk_text"].split()) == r["token_count"]
        seen[r["file_id"]] = seen.get(r["file_id"], 0) + 1
    assert [seen.get(i, 0) for i in range(6)] == [0, 0, 1, 1, 1, 1] and seen[6] == 2
