"""Cleaning of blocks: white space, junk characters, blank blocks, repeated page heads and feet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions.text import clean_line, normalize, repair_encoding

EDGE, LONGEST, FEWEST_PAGES = 2, 200, 3
#: Signatures that a file's metrics list.
SIGNATURES_LISTED = 20


def cleaned_blocks(blocks: DataFrame, repair: bool = False) -> DataFrame:
    """blocks: file_id, page_no, block_no, text. Adds `clean`, `norm` and `fixed` (encoding repaired: a Python
    step, on demand)."""
    source = repair_encoding("text") if repair else F.col("text")
    out = blocks.withColumn("__source", source)
    return out.withColumn("clean", clean_line(F.col("__source"))).withColumn("fixed", F.col("__source") != F.col("text")).withColumn("norm", normalize(F.col("clean"))).drop("__source")


def boilerplate(blocks: DataFrame) -> DataFrame:
    """file_id, norm, pages: keys among the first and last two blocks (200 characters at most) of at least
    half of a file's pages, three at least; none in files of fewer pages. Blocks of one page that differ as
    they stand count apart even if their keys are equal."""
    page = Window.partitionBy("file_id", "page_no")
    edge = blocks.withColumn("__n", F.row_number().over(page.orderBy("block_no"))).withColumn("__of", F.count("*").over(page))
    edge = edge.where((F.col("__n") <= EDGE) | (F.col("__n") > F.col("__of") - EDGE)).where((F.length("clean") <= LONGEST) & (F.col("norm") != ""))
    counts = edge.select("file_id", "page_no", "clean", "norm").distinct().groupBy("file_id", "norm").agg(F.count("*").alias("pages"))
    of_file = blocks.groupBy("file_id").agg(F.countDistinct("page_no").alias("all_pages"))
    enough = F.greatest(F.lit(3), F.ceil(F.col("all_pages") * 0.5))
    return counts.join(of_file, "file_id").where((F.col("all_pages") >= FEWEST_PAGES) & (F.col("pages") >= enough)).select("file_id", "norm", "pages")


def kept_blocks(blocks: DataFrame, signatures: DataFrame) -> DataFrame:
    """Neither blank nor, anywhere in its file, a signature."""
    return blocks.where("clean <> ''").join(signatures.select("file_id", "norm"), ["file_id", "norm"], "left_anti")


def clean_metrics(blocks: DataFrame, signatures: DataFrame) -> DataFrame:
    """Per file: characters before and after (blocks and pages joined by line feeds), retention, blocks removed."""
    marked = blocks.join(signatures.select("file_id", "norm", F.lit(True).alias("is_signature")), ["file_id", "norm"], "left")
    keep = (F.col("clean") != "") & F.col("is_signature").isNull()
    by_page = marked.groupBy("file_id", "page_no").agg(
        (F.sum(F.length("text")) + F.count("*") - 1).alias("before"),
        F.coalesce(F.sum(F.when(keep, F.length("clean") + 1)) - 1, F.lit(0)).alias("after"),
        F.count_if(F.col("clean") == "").alias("blank"),
        F.count_if((F.col("clean") != "") & F.col("is_signature")).alias("repeated"),
        F.count_if("fixed").alias("fixes"),
    )
    files = by_page.groupBy("file_id").agg(
        (F.sum("before") + F.count("*") - 1).alias("original_chars"), (F.sum("after") + F.count("*") - 1).alias("cleaned_chars"),
        F.sum("blank").alias("blank_blocks_removed"), F.sum("repeated").alias("header_footer_removed"), F.sum("fixes").alias("encoding_fixes"),
    )
    retention = F.when(F.col("original_chars") > 0, F.col("cleaned_chars") / F.col("original_chars")).otherwise(1.0)
    return (
        files.withColumn("removed_chars", F.greatest(F.lit(0), F.col("original_chars") - F.col("cleaned_chars")))
        .withColumn("retention_ratio", F.round(retention, 4))
        .withColumn("clean_score", F.round(F.least(retention, F.lit(1.0)) * 100, 2))
    )


def with_signatures(metrics: DataFrame, signatures: DataFrame, most: int = SIGNATURES_LISTED) -> DataFrame:
    """The metrics with `header_footer_signatures`: a file's signatures in order, `most` of them at most; none is an empty list."""
    listed = signatures.groupBy("file_id").agg(F.slice(F.sort_array(F.collect_set("norm")), 1, most).alias("header_footer_signatures"))
    return metrics.join(listed, "file_id", "left").withColumn("header_footer_signatures", F.coalesce("header_footer_signatures", F.array().cast("array<string>")))


def clean_flags(metrics: DataFrame) -> DataFrame:
    """hard and soft, from the rounded retention."""
    r = F.col("retention_ratio")
    return metrics.withColumn("hard_fail", r < 0.60).withColumn("soft_flag", (r >= 0.60) & ((r < 0.80) | (r > 0.999)))
