"""Fill-in-middle documents: texts cut in three by digests of their ids and put in another order. Column functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import named

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
CODE_POINTS = "(?s)."


def draw(digest: Column, k: int) -> Column:
    """The k-th eight hexadecimal digits of a digest, as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output of this form was made of, by its sentinels alone."""
    prefix, suffix, middle = sentinels

    def parts(first: str, second: str) -> list[Column]:
        at, end = F.locate(second, output), F.locate(middle, output)
        between = lambda a, b: F.substring(output, a, b - a)
        return [between(F.lit(len(first) + 1), at), between(at + len(second), end), F.substring(output, end + len(middle), F.char_length(output))]

    (p, s, m), (s2, p2, m2) = parts(prefix, suffix), parts(suffix, prefix)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def fill_in_middle(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", seed: int = 1, unit: str = CODE_POINTS, plain_percent: int = 10, spm_percent: int = 20, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """The rows of `df` with `n` (units of the text, long), `form` (plain, psm or spm), `prefix_chars` and
    `middle_chars` (code points; null if plain) and `output`; input columns with these names are replaced, all others
    are handed on, of any names.

    `unit` is a pattern whose matches, left to right, make up the text (code points; `(?s)\\S+\\s*|\\s+` for words): what
    no match covers would be lost, so a text that its units don't give back is plain. Cuts and form
    follow from sha256 of the seed and the id, so a row's output doesn't depend on others, on partitions or on retries:
    no exchange, no state. Texts that hold a sentinel are plain; so `restored` always gives the text back.

    A null text counts as empty, and an empty text is plain. A null id counts as an empty one. Ties and repeated rows
    have equal outputs. The unit array of a very long text takes about 60 bytes of a task's memory a unit.
    """
    df = df.drop("n", "form", "prefix_chars", "middle_chars", "output")
    columns = df.columns
    rows = df.toDF(*(f"c{i}" for i in range(len(columns))))
    text = F.coalesce(f"c{columns.index(text_col)}", F.lit(""))
    key = F.coalesce(F.col(f"c{columns.index(id_col)}").cast("string"), F.lit(""))
    digest, units = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), F.col("units")
    rows = rows.select("*", text.alias("text"), digest.alias("digest"), F.regexp_extract_all(text, F.lit(unit), F.lit(0)).alias("units"))
    rows = rows.withColumn("n", F.size("units").cast("long"))
    a, b = (F.pmod(draw(F.col("digest"), k), F.col("n") + 1) for k in (1, 2))
    rows = rows.withColumns({"a": F.least(a, b).cast("int"), "b": F.greatest(a, b).cast("int")})
    joined = lambda x: F.array_join(x, "")
    rows = rows.withColumns({"prefix": joined(F.slice(units, 1, F.col("a"))), "middle": joined(F.slice(units, F.col("a") + 1, F.col("b") - F.col("a"))), "suffix": joined(F.slice(units, F.col("b") + 1, F.size(units) - F.col("b")))})
    prefix, suffix, middle = (F.lit(s) for s in sentinels)
    plain = (F.col("text") == "") | (F.pmod(draw(F.col("digest"), 3), F.lit(100)) >= 100 - plain_percent)
    for s in sentinels:
        plain = plain | F.contains("text", F.lit(s))
    if unit != CODE_POINTS:
        plain = plain | (F.concat("prefix", "middle", "suffix") != F.col("text"))
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.pmod(draw(F.col("digest"), 4), F.lit(100)) < spm_percent, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    output = F.when(F.col("form") == "psm", F.concat(prefix, "prefix", suffix, "suffix", middle, "middle")).when(F.col("form") == "spm", F.concat(suffix, "suffix", prefix, "prefix", middle, "middle")).otherwise(F.col("text"))
    chars = lambda c: F.when(cut, F.char_length(c).cast("long"))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def middle_digests(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """For each row: doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text restored from it."""
    told = fill_in_middle(df.select(named(id_col).alias("doc_id"), named(text_col).alias("text")), **params)
    back = restored(F.col("output"), F.col("form"), params.get("sentinels", SENTINELS))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
