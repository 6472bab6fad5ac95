"""Evaluation of retrieval: gold chunks from quotes, recall, reciprocal rank, nDCG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.functions.text import normalize

KS = (5, 10, 20)


def evidence_of(golden: DataFrame) -> DataFrame:
    """A row for each piece of evidence of the answerable records."""
    return golden.where("answerable").select("id", "doc_scope", F.posexplode("gold_evidence").alias("evidence_no", "e")).select("id", "doc_scope", "evidence_no", "e.*")


#: Words that a quote is looked up by.
RUN = 4


def map_gold(evidence: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """evidence: id, evidence_no, quote and `keys`; chunks: chunk_id, chunk_text_norm and `keys`. Pairs where the
    normalised quote, if not empty, is part of the chunk. Give keys (file, scope, page) where there are any.

    Without keys a quote is looked up by a hash of its second to fifth word, which stand in the chunk as they are
    (its first and last may be parts of words), among those of all runs of four words; what is found so is
    compared whole. Only quotes of fewer than six words are searched for in every chunk."""
    asked = evidence.withColumn("__quote", normalize(F.col("quote"))).where("__quote <> ''")
    inside = F.expr("contains(chunk_text_norm, __quote)")
    if keys:
        on = inside
        for k in keys:
            on &= asked[k] == chunks[k]
        return asked.join(chunks, on).select(asked["id"], "evidence_no", "chunk_id")
    asked = asked.select("id", "evidence_no", "__quote", F.split("__quote", " ").alias("__words"))
    texts, few = chunks.select("chunk_id", "chunk_text_norm"), F.size("__words") < RUN + 2
    runs = texts.select("chunk_id", F.split("chunk_text_norm", " ").alias("w")).where(F.size("w") >= RUN)
    hashed = F.transform(F.sequence(F.lit(1), F.size("w") - (RUN - 1)), lambda i: F.xxhash64(F.slice("w", i, RUN)))
    runs = runs.select("chunk_id", F.explode(F.array_distinct(hashed)).alias("__run"))
    long = asked.where(~few).withColumn("__run", F.xxhash64(F.slice("__words", 2, RUN)))
    found = long.join(runs, "__run").join(texts, "chunk_id").where(inside).select("id", "evidence_no", "chunk_id")
    short = asked.where(few)
    return found if short.isEmpty() else found.union(short.join(texts, inside).select("id", "evidence_no", "chunk_id"))


def mapping_rate(evidence: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: evidences, mapped ones, rate (1 without evidence)."""
    hit = mapped.select("id", "evidence_no").distinct().withColumn("__hit", F.lit(1))
    out = evidence.select("id", "evidence_no").join(hit, ["id", "evidence_no"], "left").agg(F.count("*").alias("evidences"), F.count("__hit").alias("mapped"))
    return out.withColumn("rate", F.when(F.col("evidences") > 0, F.round(F.col("mapped") / F.col("evidences"), 4)).otherwise(1.0))


def unmapped(evidence: DataFrame, mapped: DataFrame) -> DataFrame:
    return evidence.join(mapped.select("id", "evidence_no").distinct(), ["id", "evidence_no"], "left_anti").select("id", "evidence_no", F.substring("quote", 1, 60).alias("quote"))


def check_evidence(evidence: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds file_exists (completed, of that name and scope) and quote_found (in one of its chunks; an empty
    quote is in any)."""
    done = files.where("status = 'COMPLETED'").select("file_id", "file_name", "doc_scope")
    there = done.select("file_name", "doc_scope").distinct().withColumn("__file", F.lit(True))
    of_files = chunks.join(done, "file_id").select("file_name", "doc_scope", "chunk_text_norm")
    asked = evidence.withColumn("__quote", normalize(F.col("quote")))
    hit = asked.join(of_files, ["file_name", "doc_scope"]).where("contains(chunk_text_norm, __quote)").select("id", "evidence_no").distinct().withColumn("__hit", F.lit(True))
    out = evidence.join(there, ["file_name", "doc_scope"], "left").join(hit, ["id", "evidence_no"], "left")
    return out.select("id", "evidence_no", "file_name", "doc_scope", F.coalesce("__file", F.lit(False)).alias("file_exists"), F.coalesce("__hit", F.lit(False)).alias("quote_found"))


def evidence_mismatches(golden: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, evidence_no, file_name, doc_scope, page, sheet, quote and reason of the evidence that is not in the corpus:
    file_not_found (no completed file of that name and scope), location_not_found (no chunk of it on that page or
    sheet) or quote_not_found (in none of those chunks, normalised; an empty quote is in any)."""
    evidence = golden.select("id", "doc_scope", F.posexplode("gold_evidence").alias("evidence_no", "e")).select("id", "doc_scope", "evidence_no", "e.*")
    done = files.where("status = 'COMPLETED'").select("file_id", "file_name", "doc_scope")
    there = done.select("file_name", "doc_scope").distinct().withColumn("__file", F.lit(True))
    of_files = chunks.select("file_id", "page_number", "sheet_name", "chunk_text_norm").join(done, "file_id").drop("file_id")
    asked = evidence.withColumn("__quote", normalize(F.col("quote")))
    on_place = (F.col("page").isNull() | (F.col("page") == F.col("page_number"))) & (F.col("sheet").isNull() | (F.col("sheet") == F.col("sheet_name")))
    at = asked.join(of_files, ["file_name", "doc_scope"]).where(on_place).groupBy("id", "evidence_no").agg(F.max(F.expr("coalesce(contains(chunk_text_norm, __quote), false)")).alias("__hit"))
    out = evidence.join(there, ["file_name", "doc_scope"], "left").join(at, ["id", "evidence_no"], "left")
    reason = F.when(F.col("__file").isNull(), "file_not_found").when(F.col("__hit").isNull(), "location_not_found").when(~F.col("__hit"), "quote_not_found")
    return out.select("id", "evidence_no", "file_name", "doc_scope", "page", "sheet", "quote", reason.alias("reason")).where("reason is not null")


def query_metrics(questions: DataFrame, gold: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """questions: id (and what else there is). gold: id, chunk_id (distinct). ranked: id, chunk_id, rank. Per
    question recall and nDCG at each k, and the reciprocal rank of the first hit; all 0 without gold."""
    gold = gold.select("id", "chunk_id").distinct()
    of_gold = gold.groupBy("id").agg(F.count("*").alias("__gold"))
    hits = ranked.join(gold, ["id", "chunk_id"], "left_semi").groupBy("id").agg(
        F.min("rank").alias("__first"),
        *(F.count_if(F.col("rank") <= k).alias(f"__hit{k}") for k in ks),
        *(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias(f"__dcg{k}") for k in ks),
    )
    out = questions.join(of_gold, "id", "left").join(hits, "id", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("__gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = F.lit(0.0)
    measures = {f"recall_at_{k}": F.coalesce(F.col(f"__hit{k}") / F.col("__gold"), zero) for k in ks}
    measures |= {"mrr": F.coalesce(1 / F.col("__first"), zero)}
    measures |= {f"ndcg_at_{k}": F.coalesce(F.col(f"__dcg{k}") / ideal(k), zero) for k in ks}
    return out.select(*questions.columns, *(v.alias(n) for n, v in measures.items()))


def aggregated(measured: DataFrame, by: str = "category") -> DataFrame:
    """Means to four places over all (that column null) and by category, with n."""
    names = [c for c in measured.columns if c.startswith(("recall", "ndcg", "mrr"))]
    return measured.rollup(by).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in names))


def golden_rules(golden: DataFrame) -> DataFrame:
    """The records that break a rule, a row for each rule broken, with its `problem`."""
    ev = F.coalesce("gold_evidence", F.array().cast(golden.schema["gold_evidence"].dataType))
    checks = {
        "evidence needs a page or a sheet, not both": F.exists(ev, lambda e: e["page"].isNull() == e["sheet"].isNull()),
        "answerable needs evidence, unanswerable none": F.col("answerable") != (F.size(ev) > 0),
        "category does not fit answerable": (F.col("category") == "unanswerable") == F.col("answerable"),
        "unknown category": ~F.col("category").isin("single_fact", "multi_hop", "synthesis", "table_based", "citation_sensitive", "unanswerable"),
        "difficulty is not 1 to 3": ~F.coalesce(F.col("difficulty").between(1, 3), F.lit(False)),
    }
    return golden.withColumn("problem", F.explode(F.array_compact(F.array(*(F.when(c, m) for m, c in checks.items())))))


def golden_problems(golden: DataFrame) -> DataFrame:
    """id and problem, for records that break a rule; and those that repeat an id or a normalised question."""
    own = golden_rules(golden).select("id", "problem")
    twice = golden.groupBy("id").count().where("count > 1").select("id", F.lit("id occurs more than once").alias("problem"))
    asked = golden.groupBy(normalize(F.col("question")).alias("q")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).where("n > 1")
    return own.union(twice).union(asked.select(F.explode("ids").alias("id"), F.lit("question occurs more than once").alias("problem")))
