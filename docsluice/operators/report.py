"""Corpus report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.schema import TERMINAL

TARGET = 0.95


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("files"))


def parse_rate(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: all, terminal and pending files, terminal ones with a good parse, rate, target met."""
    ok = metrics.where("step = 'parse' and ok").select("file_id").distinct().withColumn("__ok", F.lit(1))
    terminal = F.col("status").isin(*TERMINAL)
    out = files.join(ok, "file_id", "left").agg(F.count("*").alias("total_files"), F.count_if(terminal).alias("terminal_files"), F.count_if(terminal & F.col("__ok").isNotNull()).alias("parse_ok"))
    rate = F.when(F.col("terminal_files") > 0, F.col("parse_ok") / F.col("terminal_files")).otherwise(0.0)
    return out.select("*", (F.col("total_files") - F.col("terminal_files")).alias("pending_files"), F.round(rate, 4).alias("parse_success_rate"), ((rate >= TARGET) & (F.col("terminal_files") > 0)).alias("parse_success_met"))


def step_durations(files: DataFrame, metrics: DataFrame) -> DataFrame:
    return metrics.join(files.select("file_id"), "file_id", "left_semi").groupBy("step").agg(F.round(F.avg("duration_ms"), 1).alias("avg_ms"))


def chunk_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    own = chunks.join(files.select("file_id"), "file_id", "left_semi")
    return own.agg(F.count("*").alias("chunks"), F.round(F.avg("token_count"), 1).alias("token_avg"), F.round(F.expr("percentile(token_count, 0.95)"), 3).alias("token_p95"))


def quality_distribution(files: DataFrame) -> DataFrame:
    score = F.col("quality_score").cast("double")
    return files.where("quality_score is not null").agg(F.min(score).alias("lowest"), F.round(F.avg(score), 2).alias("mean"), F.round(F.percentile(score, 0.95), 3).alias("p95"), F.count("*").alias("scored_files"))


def lowest_scores(files: DataFrame, n: int = 10) -> DataFrame:
    return files.where("quality_score is not null").orderBy("quality_score", "file_id").limit(n).select("file_id", "file_name", F.col("quality_score").cast("double").alias("quality_score"))


def open_findings(files: DataFrame, findings: DataFrame) -> DataFrame:
    return findings.where("not resolved").join(files.select("file_id"), "file_id", "left_semi").groupBy("finding").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "finding")


def cross_file_duplicates(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Number of normalised texts that chunks of more than one file have."""
    own = chunks.join(files.select("file_id"), "file_id", "left_semi")
    return own.groupBy("chunk_text_norm").agg(F.min("file_id").alias("a"), F.max("file_id").alias("b")).where("a <> b").agg(F.count("*").alias("groups"))


def recovered(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """Completed files that were tried again or had a step fail."""
    failed = metrics.where("ok = false").select("file_id").distinct().withColumn("__failed", F.lit(True))
    return files.where("status = 'COMPLETED'").join(failed, "file_id", "left").where((F.col("retry_count") > 0) | F.col("__failed")).agg(F.count("*").alias("recovered_files"))


def build_report(files: DataFrame, metrics: DataFrame, chunks: DataFrame, findings: DataFrame, scope: str | None = None) -> dict:
    """All of it as a dict; every part is an aggregate of a few rows."""
    files = files if scope is None else files.where(F.col("doc_scope") == scope)
    row = lambda df: df.first().asDict()
    return {
        **row(parse_rate(files, metrics)), "parse_success_target": TARGET,
        "status_distribution": {r["status"]: r["files"] for r in status_counts(files).collect()},
        "step_avg_ms": {r["step"]: r["avg_ms"] for r in step_durations(files, metrics).collect()},
        "chunks": row(chunk_stats(files, chunks)), "quality_distribution": row(quality_distribution(files)),
        "lowest_scored_10": [r.asDict() for r in lowest_scores(files).collect()],
        "open_qc_findings": {r["finding"]: r["findings"] for r in open_findings(files, findings).collect()},
        "cross_file_duplicate_groups": cross_file_duplicates(files, chunks).first()[0],
        "completed_without_score": files.where("status = 'COMPLETED' and quality_score is null").count(), "recovered_files": recovered(files, metrics).first()[0],
    }


def render(report: dict) -> str:
    lines = [f"{k}: {v}" for k, v in report.items() if not isinstance(v, (dict, list))]
    for k, v in report.items():
        if isinstance(v, dict):
            lines += [f"{k}:", *(f"  {a}: {b}" for a, b in sorted(v.items()))]
        elif isinstance(v, list):
            lines += [f"{k}:", *(f"  {x}" for x in v)]
    return "\n".join(lines)
