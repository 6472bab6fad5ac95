"""Chunk findings and the composite quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"parse": 0.35, "clean": 0.20, "chunk": 0.25, "embed": 0.20}


def chunk_findings(chunks: DataFrame, least: int = 30, most: int = 512) -> DataFrame:
    """file_id, chunk_id, finding: empty chunks (nothing else is found of them), too short, too long, and
    those whose normalised text an earlier chunk of the file has."""
    norm = F.coalesce("chunk_text_norm", F.lit(""))
    empty = F.trim(norm) == ""
    again = F.row_number().over(Window.partitionBy("file_id", norm).orderBy("chunk_index", "chunk_id")) > 1
    codes = F.when(empty, F.array(F.lit("empty_chunk"))).otherwise(F.array_compact(F.array(
        F.when(F.col("token_count") < least, "too_short"), F.when(F.col("token_count") > most, "too_long"), F.when(again, "duplicate_chunk"),
    )))
    listed = chunks.select("file_id", "chunk_id", "chunk_index", codes.alias("codes"))
    return listed.select("file_id", "chunk_id", "chunk_index", F.explode("codes").alias("finding"))


def sub_scores(metrics: DataFrame) -> DataFrame:
    """Per file: the scores in the steps' details (JSON). Parsing: the last attempt's (none given: the first);
    other steps: the latest row's; cleaning falls back to its retention."""
    number = lambda path: F.get_json_object("detail", path).cast("double")
    attempt = F.coalesce(F.get_json_object("detail", "$.attempt").cast("int"), F.lit(1))
    last = lambda step, value, order: F.max_by(value, F.when(F.col("step") == step, order))
    newest = F.struct(F.lit(0), F.col("metric_id"))
    clean = F.coalesce(number("$.clean_score"), F.round(F.least(number("$.retention_ratio"), F.lit(1.0)) * 100, 2))
    return metrics.groupBy("file_id").agg(
        last("parse", F.struct(number("$.parse_score").alias("v")), F.struct(attempt, -F.col("metric_id")))["v"].alias("parse"), last("clean", F.struct(clean.alias("v")), newest)["v"].alias("clean"),
        last("chunk", F.struct(number("$.chunk_score").alias("v")), newest)["v"].alias("chunk"), last("embed", F.struct(number("$.embed_score").alias("v")), newest)["v"].alias("embed"),
    )


def quality_scores(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the scores there are, to two places; null without any or without weight."""
    w = weights or WEIGHTS
    have = {k: F.col(k).isNotNull() for k in w}
    top = sum((F.when(have[k], F.col(k) * w[k]).otherwise(0.0) for k in w), F.lit(0.0))
    below = sum((F.when(have[k], F.lit(float(w[k]))).otherwise(0.0) for k in w), F.lit(0.0))
    return sub_scores(metrics).withColumn("quality_score", F.when(below > 0, F.round(top / below, 2)))


def without_score(files: DataFrame) -> DataFrame:
    return files.where("status = 'COMPLETED' and quality_score is null")


def backfilled(files: DataFrame, metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Files with scores filled in where completed ones have none."""
    new = quality_scores(metrics, weights).select("file_id", F.col("quality_score").cast(files.schema["quality_score"].dataType).alias("__new"))
    due = (F.col("status") == "COMPLETED") & F.col("quality_score").isNull()
    return files.join(new, "file_id", "left").withColumn("quality_score", F.when(due, F.col("__new")).otherwise(F.col("quality_score"))).drop("__new")
