"""Context assembly: from a retrieved list to numbered blocks under a token budget.

Lists are rows with a `pos`; several lists (one per `query_id`) are built at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions.text import word_count

BUDGET, MARGIN, LOW_QUALITY = 4000, 1.1, 70.0


def dedup(retrieved: DataFrame) -> DataFrame:
    """Of a chunk's entries the best score stays, the first of equals, where it stands."""
    best = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "pos"))
    return retrieved.withColumn("__n", best).where("__n = 1").drop("__n")


def dedup_first_place(retrieved: DataFrame) -> DataFrame:
    """Of a chunk's entries the best score stays, at the place of the first entry."""
    order = F.struct(F.col("score"), -F.col("pos"))
    rest = [c for c in retrieved.columns if c not in ("query_id", "chunk_id", "pos")]
    return retrieved.groupBy("query_id", "chunk_id").agg(F.min("pos").alias("pos"), *(F.max_by(c, order).alias(c) for c in rest))


def merge_adjacent(chunks: DataFrame) -> DataFrame:
    """Adds block: entries that follow each other in the list and in their file are one."""
    order = Window.partitionBy("query_id").orderBy("pos")
    follows = (F.col("file_id") == F.lag("file_id").over(order)) & (F.col("chunk_index") == F.lag("chunk_index").over(order) + 1)
    return chunks.withColumn("block", F.sum(F.when(follows, 0).otherwise(1)).over(order))


def location(sheet: Column, page: Column) -> Column:
    return F.when(F.coalesce(sheet, F.lit("")) != "", F.concat(F.lit("sheet "), sheet)).when(page.isNotNull(), F.concat(F.lit("s."), page.cast("string"))).otherwise("konum?")


def blocks_of(merged: DataFrame, low_quality: float = LOW_QUALITY) -> DataFrame:
    """One row per block: score, place, text, label without its number, chunk ids, tokens, quality mark."""
    items = F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "chunk_text", "file_name", "page_number", "sheet_name", "section_title")))
    grouped = merged.groupBy("query_id", "block").agg(
        F.max("score").alias("score"), F.min("pos").alias("pos"), F.sum("token_count").alias("token_count"), items.alias("items"),
        F.coalesce(F.bool_or(F.col("quality_score") < low_quality), F.lit(False)).alias("low_quality"),
    )
    first = F.col("items")[0]
    section = F.when(F.coalesce(first["section_title"], F.lit("")) != "", first["section_title"])
    label = F.concat_ws(", ", first["file_name"], location(first["sheet_name"], first["page_number"]), section)
    return grouped.withColumn("place_label", label).withColumn("text", F.array_join(F.col("items")["chunk_text"], "\n")).withColumn("chunk_ids", F.col("items")["chunk_id"]).drop("items")


def within_budget(blocks: DataFrame, budget: int = BUDGET, margin: float = MARGIN) -> DataFrame:
    """Adds kept. Blocks are given up from the lowest score, the latest of equals first, until label and text
    of the rest fit. A label's words do not depend on its number, so what is kept is the longest run from the
    best block on whose running sum fits; nothing, if the best block alone does not."""
    size = word_count(F.concat(F.lit("[1] "), F.col("place_label"), F.lit("\n"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("kept", F.floor(F.sum(size).over(order) * F.lit(float(margin))) <= budget)


def render(blocks: DataFrame) -> DataFrame:
    """Kept blocks numbered in list order, with their labels."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return blocks.where("kept").withColumn("n", n).withColumn("label", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("place_label"))).select("query_id", "n", "label", "text", "chunk_ids", "token_count", "low_quality")


def citations(rendered: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each chunk of each block, with where it is from."""
    each = rendered.select("query_id", "n", F.posexplode("chunk_ids").alias("i", "chunk_id"))
    return each.join(chunks.select("chunk_id", "file_name", "page_number", "sheet_name", "section_title"), "chunk_id").drop("i")


def build_context(retrieved: DataFrame, metadata: DataFrame, budget: int = BUDGET, margin: float = MARGIN, low_quality: float = LOW_QUALITY) -> tuple[DataFrame, DataFrame]:
    """Rendered blocks, and the chunk ids of those given up. retrieved: query_id, pos, chunk_id, score, chunk_text;
    metadata: chunk_id, file_id, file_name, chunk_index, token_count, page_number, sheet_name, section_title,
    quality_score. Chunks without metadata drop out."""
    blocks = within_budget(blocks_of(merge_adjacent(dedup(retrieved).join(metadata, "chunk_id")), low_quality), budget, margin)
    return render(blocks), blocks.where("not kept").select("query_id", F.explode("chunk_ids").alias("chunk_id"))
