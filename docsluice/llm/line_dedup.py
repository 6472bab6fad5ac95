"""Lines that many documents share, found by hashes of normalised lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import Scratch, named

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines between line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z as a-z; other letters as they are."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def without_places(items: Column, places: Column) -> Column:
    """An array without the elements at `places` (ascending, from 0): the slices between them, put together, so
    that the work is linear in both."""
    starts, ends = F.concat(F.array(F.lit(-1)), places), F.concat(places, F.array(F.size(items)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(items, s + 2, e - s - 1)))


def drop_common_lines(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", least_documents: int = 2, least_chars: int = 10, keep_first: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """The rows of `df` with texts that lack the lines which `least_documents` rows or more have.

    Lines are compared by `line_key`; keys below `least_chars` code points stay everywhere. With `keep_first` a
    line stays, as often as it stands there, in the rows of the smallest id that has it; else it goes everywhere.
    Columns `n_lines` (before) and `n_dropped` (both long) are added; input columns with these names are replaced,
    all others, of any names, are handed on.

    Keys are compared by MD5, 128 bits. The rows' hashes are written once to the shared folder. A row sends each
    hash once, counts and smallest ids are added up before the exchange, so a line that a third of all rows have is
    one row a task there. What says which lines go (hash, first id) is joined to the hashes and their places, and
    the places to the texts; both joins read written tables, so that adaptive execution splits a hot key and
    broadcasts only what it has measured as small. Texts are read twice and exchanged once.

    A null text stays null, counted as one empty line; a text all of whose lines go becomes empty. Rows with a null
    id count as one document behind all ids. Rows equal in id are the same document to `keep_first`, but count
    one by one towards `least_documents`. Very long texts are split like others, with about 50 bytes a line more. An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    df = df.drop("n_lines", "n_dropped")
    columns = df.columns
    # columns by number: names may have dots, or be ours
    rows = df.toDF(*(f"c{i}" for i in range(len(columns))))
    doc, text = F.col(f"c{columns.index(id_col)}"), f"c{columns.index(text_col)}"
    rows = rows.withColumns({"doc": doc, "tag": F.xxhash64(text)})
    digest = lambda line: F.when(F.char_length(line_key(line)) >= least_chars, F.md5(line_key(line)))
    with Scratch(spark) as tmp:
        hashes = tmp.saved(rows.select("doc", "tag", F.transform(lines_of(F.col(text)), digest).alias("hashes")), "line-hashes")
        once = hashes.select("doc", F.explode(F.array_distinct("hashes")).alias("hash")).where("hash IS NOT NULL")
        common = once.groupBy(F.unhex("hash").alias("hash")).agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least_documents)
        common = tmp.saved(common.select("hash", "first"), "common-lines")
        placed = hashes.select("doc", "tag", F.posexplode("hashes").alias("place", "hash")).where("hash IS NOT NULL").withColumn("hash", F.unhex("hash"))
        gone = placed.join(common, "hash")
        gone = gone.where(~F.col("doc").eqNullSafe(F.col("first"))) if keep_first else gone
        gone = tmp.saved(gone.groupBy("doc", "tag").agg(F.sort_array(F.collect_set("place")).alias("places")), "dropped-places")
        gone = gone.toDF("its_doc", "its_tag", "places")
        told = rows.join(gone, F.col("doc").eqNullSafe(F.col("its_doc")) & (F.col("tag") == F.col("its_tag")), "left")
        told = told.withColumn("lines", lines_of(F.col(text)))
        kept = F.when(F.col("places").isNull(), F.col(text)).otherwise(F.array_join(without_places(F.col("lines"), F.col("places")), "\n"))
        out = told.select(*(kept.alias(c) if c == text else F.col(c) for c in rows.columns[: len(columns)]), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
        out = scratch.saved(out, "lines-dropped")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "n_lines", "n_dropped")


def line_digests(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """For each row: doc_id, n_lines, n_dropped and the sha256 of the text that is left (null: empty)."""
    told = drop_common_lines(df.select(named(id_col).alias("doc_id"), named(text_col).alias("text")), **params)
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
