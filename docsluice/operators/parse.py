"""Parsed documents: metrics and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions.text import garbage_count


def body_text(pages: Column) -> Column:
    """Blocks and pages joined by line feeds; an empty page is a line feed too."""
    return F.array_join(F.transform(pages, lambda p: F.array_join(p["text_blocks"], "\n")), "\n")


def scan_text(pages: Column, tables: Column) -> Column:
    return F.concat_ws("\n", body_text(pages), F.array_join(F.transform(tables, lambda t: F.coalesce(t["flattened_text"], F.lit(""))), "\n"))


def parse_metrics(docs: DataFrame) -> DataFrame:
    """docs: PARSED and file_type. Coverage: share of pages with text (pdf, docx), else whether there is any
    content; garbage: share of junk characters in body and tables; score from both."""
    pages, tables, figures = F.col("pages"), F.col("tables"), F.col("figures")
    has_text = lambda p: F.exists(p["text_blocks"], lambda b: F.trim(b) != "")
    any_on = lambda p: has_text(p) | F.exists(tables, lambda t: t["page_no"] == p["page_no"]) | F.exists(figures, lambda f: f["page_no"] == p["page_no"])
    n = F.size(pages)
    share = lambda f: F.when(n > 0, F.size(F.filter(pages, f)) / n).otherwise(0.0)
    content = F.when(F.exists(pages, has_text) | (F.size(tables) > 0), 1.0).otherwise(0.0)  # line feeds between blocks are none
    paged = F.col("file_type").isin("pdf", "docx")
    out = docs.withColumn("__text", scan_text(pages, tables))
    out = out.withColumn("__coverage", F.when(paged, share(has_text)).otherwise(content)).withColumn("__ratio", F.when(paged, share(any_on)).otherwise(content))
    out = out.withColumn("__garbage", F.when(F.length("__text") > 0, garbage_count(F.col("__text")) / F.length("__text")).otherwise(0.0))
    return out.select(
        "file_id", F.round("__coverage", 4).alias("coverage"), F.round("__ratio", 4).alias("page_ratio"), F.round("__garbage", 4).alias("garbage_ratio"), F.size(tables).alias("table_count"), F.size(figures).alias("figure_count"),
        F.size("sections").alias("section_count"), n.alias("page_count"), F.length("__text").alias("char_count"), F.round(100.0 * F.col("__coverage") * (1.0 - F.col("__garbage")), 2).alias("parse_score"),
    )


def parse_flags(metrics: DataFrame) -> DataFrame:
    hard = (F.col("coverage") < 0.50) | (F.col("garbage_ratio") > 0.20)
    return metrics.withColumn("hard_fail", hard).withColumn("soft_flag", ~hard & (F.col("coverage") < 0.85))


def dominant_size(spans: DataFrame, first_pages: int = 10) -> DataFrame:
    """spans: file_id, page_no, size, text. The font size most characters of the first pages have."""
    by_size = spans.where(F.col("page_no") <= first_pages).groupBy("file_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return by_size.groupBy("file_id").agg(F.max_by("size", F.struct("chars", "size")).alias("dominant"))
