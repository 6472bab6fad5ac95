"""Grounding: do an answer's citations hold, and do they cover its sentences?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions.text import covers, normalize, sentences

COVERAGE, HIGH = 0.70, 0.90
NO_INFO = "bulunamad"


def valid_citations(citations: DataFrame) -> DataFrame:
    """Rows whose chunk_id is a whole number (as text or number)."""
    return citations.withColumn("chunk_id", F.expr("try_cast(chunk_id as long)")).where("chunk_id is not null")


def judged_citations(citations: DataFrame, context: DataFrame) -> DataFrame:
    """citations: answer_id, n, claim, chunk_id (text), quote. context: answer_id, chunk_id, chunk_text. Adds
    issue (null if the citation holds): malformed, not in context, or a quote its chunk doesn't have; an
    empty quote is accepted."""
    c = citations.withColumn("__id", F.expr("try_cast(chunk_id as long)"))
    there = context.select("answer_id", F.col("chunk_id").alias("__id"), normalize(F.col("chunk_text")).alias("__text"))
    joined = c.join(there, ["answer_id", "__id"], "left")
    quote = normalize(F.col("quote"))
    issue = F.when(F.col("__id").isNull(), "malformed_citation").when(F.col("__text").isNull(), F.concat(F.lit("citation_not_in_context:"), F.col("__id").cast("string"))).when((quote != "") & ~F.col("__text").contains(quote), F.concat(F.lit("fabricated_quote:"), F.col("__id").cast("string")))
    return joined.withColumn("issue", issue).drop("__id", "__text")


def coverage(answer: Column, claims: Column) -> Column:
    """Share of sentences that a claim (normalised) contains or is contained in; 0 without sentences."""
    parts = sentences(answer)
    hit = F.filter(parts, lambda s: F.exists(claims, lambda c: covers(c, normalize(s))))
    return F.when(F.size(parts) > 0, F.size(hit) / F.size(parts)).otherwise(0.0)


def validate(answers: DataFrame, citations: DataFrame, context: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """answers: answer_id, answer. One row each: coverage, issues (citations' in order, then the answer's),
    passed."""
    judged = judged_citations(citations, context)
    by_answer = judged.groupBy("answer_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("issue").isNotNull(), F.struct("n", "issue")))).alias("__bad"),
        F.collect_list(F.when(F.col("issue").isNull() & (normalize(F.col("claim")) != ""), normalize(F.col("claim")))).alias("__claims"),
    )
    has_context = context.select("answer_id").distinct().withColumn("__context", F.lit(True))
    out = answers.join(by_answer, "answer_id", "left").join(has_context, "answer_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("coverage", coverage(F.col("answer"), F.coalesce("__claims", none)))
    low = F.when(F.col("coverage") < threshold, F.concat(F.lit("low_coverage:"), F.format_string("%.3f", F.bround("coverage", 3))))
    denies = F.when(F.coalesce("__context", F.lit(False)) & F.lower("answer").contains(NO_INFO), "answer_claims_no_info_despite_context")
    issues = F.concat(F.coalesce(F.transform("__bad", lambda x: x["issue"]), none), F.array_compact(F.array(low, denies)))
    return out.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0).drop("__bad", "__claims", "__context")


def confidence(cov: Column, retries: Column, fallback: Column | None = None, high: float = HIGH) -> Column:
    level = F.when((cov >= high) & (retries == 0), "high").when(cov > 0, "medium").otherwise("low")
    return level if fallback is None else F.when(fallback, "low").otherwise(level)


def sources(citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Citations as numbered sources; the number is the citation's own place, so unknown chunks leave gaps."""
    known = retrieved.select("answer_id", "chunk_id", "file_name", "page_number", "section_title").dropDuplicates(["answer_id", "chunk_id"])
    return valid_citations(citations).join(known, ["answer_id", "chunk_id"]).select("answer_id", "n", "file_name", "page_number", "section_title", "chunk_id", "quote")
