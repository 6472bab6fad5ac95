"""One query per operator, over whole tables. The SQL for them is in `docsluice.plans.oracle`."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsluice.functions.text import detect_language, normalize, sentences, word_count
from docsluice.operators import clean, context, embed, evaluate, ground, ingest, inject, intake, parse, quality, report, retrieve
from docsluice.operators.chunk import chunk_metrics, metadata_fill
from docsluice.operators.postings import term_counts
from docsluice.plans import tables as t
from docsluice.sources.charset import decoded, learn_pairs, repaired
from docsluice.sources.golden import golden_faults as read_faults
from docsluice.sources.golden import load_golden, read_golden
from docsluice.operators.snapshots import Snapshots
from docsluice.streaming.intake import file_stream, into_store, run_available

SCOPES = ["src0", "src1", "src2", "src3", "src4"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _plain(df: DataFrame) -> DataFrame:
    """A search's rows with rounded scores."""
    return df.select("chunk_id", F.col("source.file_name").alias("file_name"), F.round("score", 6).alias("score"), "rank")


def _search(spark, d):
    return t.whole_chunks(spark, d), t.vectors(spark, d), t.files(spark, d), t.query_vector(spark, d)


@query
def retrieval_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks, vectors, files, q = _search(spark, d)
    return _plain(retrieve.search_dense(chunks, vectors, files, q, SCOPES))


@query
def retrieval_dense_filtered(spark, d):
    chunks, vectors, files, q = _search(spark, d)
    return _plain(retrieve.search_dense(chunks, vectors, files, q, SCOPES, where=retrieve.metadata_filter(language="en", date_from="2024-01-05", date_to="2024-01-25")))


@query
def filter_date_range(spark, d):
    orders = t.table(spark, d, "orders").where(retrieve.metadata_filter(date_from="1995-01-01", date_to="1996-12-31", created="o_orderdate"))
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def lexical_index(spark, d):
    """Writes the stored index (the first of these queries does), and tells of every term how often it occurs."""
    return term_counts(t.postings(spark, d))


def _lexical(spark, d, query, scopes=SCOPES, variant="simple"):
    index = t.postings(spark, d, "trigrams" if variant == "trgm" else "words")
    return _plain(retrieve.search_lexical(t.whole_chunks(spark, d), t.files(spark, d), query, scopes, variant=variant, index=index))


@query
def retrieval_sparse_simple(spark, d):
    return _lexical(spark, d, "the")


@query
def retrieval_sparse_unaccent(spark, d):
    return _lexical(spark, d, "à", ["src5", "src6", "src7"], "unaccent")


@query
def retrieval_sparse_several(spark, d):
    return _lexical(spark, d, "with that")


@query
def retrieval_sparse_trgm(spark, d):
    return _lexical(spark, d, "nation retion", variant="trgm")


def _hybrid(spark, d, **fusion):
    chunks, vectors, files, q = _search(spark, d)
    out = retrieve.search_hybrid(chunks, vectors, files, q, "the", SCOPES, index=t.postings(spark, d), **fusion)
    return out.select("chunk_id", F.round("score", 9).alias("score"), "rank", "detail.dense_rank", "detail.sparse_rank")


@query
def retrieval_hybrid_rrf(spark, d):
    return _hybrid(spark, d)


@query
def retrieval_hybrid_weighted(spark, d):
    return _hybrid(spark, d, strategy="weighted", dense_weight=0.8, sparse_weight=0.2).withColumn("score", F.round("score", 6))


@query
def retrieval_batch_multi_query(spark, d):
    chunks, vectors, files, _ = _search(spark, d)
    asked = t.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    out = retrieve.search_dense_batch(chunks, vectors, files, asked, [f"src{i}" for i in range(20)], 5)
    return out.withColumn("score", F.round("score", 6))


@query
def retrieval_dense_indexed(spark, d):
    """`retrieval_dense_topk` by the stored cells."""
    chunks, _, files, q = _search(spark, d)
    return _plain(retrieve.search_dense(chunks, None, files, q, SCOPES, index=t.cells(spark, d)))


def _asked(spark, d):
    return t.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _batch_by_cells(spark, d, k, exact=True):
    chunks, _, files, _ = _search(spark, d)
    return retrieve.search_cells_batch(t.cells(spark, d), chunks, files, _asked(spark, d), [f"src{i}" for i in range(20)], k, exact=exact, scratch=t.written(spark))


@query
def retrieval_batch_indexed(spark, d):
    """`retrieval_batch_multi_query` by the stored cells."""
    return _batch_by_cells(spark, d, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def retrieval_index_recall(spark, d):
    """Of each query's ten nearest, how many the nearest cells alone have."""
    wanted = retrieve.search_dense_batch(*_search(spark, d)[:3], _asked(spark, d), [f"src{i}" for i in range(20)], 10).select("query_id", "chunk_id")
    found = _batch_by_cells(spark, d, 10, exact=False).select("query_id", "chunk_id", F.lit(1).alias("there"))
    return wanted.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("there").alias("found"))


@query
def lookup_neighbors(spark, d):
    chunks = t.chunks(spark, d)
    return retrieve.neighbours(chunks, t.files(spark, d), chunks, SCOPES).select("anchor_id", "chunk_id", "chunk_index", "file_name", F.md5("chunk_text").alias("text_md5"))


@query
def lookup_page(spark, d):
    return retrieve.on_page(t.chunks(spark, d), t.files(spark, d), 0, 1, [f"src{i}" for i in range(20)]).select("chunk_id", "chunk_index", F.md5("chunk_text").alias("text_md5"))


def _listed(spark, d):
    ids = [5, 3, 999_999_999, 3, 8, 21, 13, 0]
    return retrieve.texts_in_order(t.whole_chunks(spark, d), t.files(spark, d), spark.createDataFrame(list(enumerate(ids)), "pos int, chunk_id long"), [f"src{i}" for i in range(20)])


@query
def rerank_texts_ordered(spark, d):
    return retrieve.rerank(_listed(spark, d), None).select("pos", "chunk_id", "score", F.md5("chunk_text").alias("text_md5"))


@query
def rerank_scored(spark, d):
    return retrieve.rerank(_listed(spark, d), lambda text: word_count(text).cast("double"), 4).select("pos", "chunk_id", "score")


def _retrieved(spark, d):
    """Each file's chunks as one list; every fifth comes again at its end, with another score."""
    c = t.chunks(spark, d)
    score = lambda k: (F.col("chunk_id") * k % 101) / 100
    again = c.where("chunk_index % 5 = 0").select(F.col("file_id").alias("query_id"), (F.col("chunk_index") + 100_000).alias("pos"), "chunk_id", score(53).alias("score"), "chunk_text")
    once = c.select(F.col("file_id").alias("query_id"), F.col("chunk_index").alias("pos"), "chunk_id", score(37).alias("score"), "chunk_text")
    meta = c.drop("chunk_text", "chunk_text_norm").join(t.files(spark, d).select("file_id", "file_name", "quality_score"), "file_id")
    return once.union(again), meta


@query
def context_dedup(spark, d):
    return context.dedup(_retrieved(spark, d)[0]).select("query_id", "pos", "chunk_id", "score")


@query
def context_dedup_first_place(spark, d):
    return context.dedup_first_place(_retrieved(spark, d)[0]).select("query_id", "pos", "chunk_id", "score")


@query
def context_merge(spark, d):
    rows, meta = _retrieved(spark, d)
    merged = context.merge_adjacent(context.dedup(rows).join(meta, "chunk_id"))
    return merged.groupBy("query_id", "block").agg(F.count("*").alias("chunks"), F.min("pos").alias("pos"), F.max("score").alias("score"), F.sum("token_count").alias("token_count"))


def _budgeted(spark, d):
    rows, meta = _retrieved(spark, d)
    blocks = context.blocks_of(context.merge_adjacent(context.dedup(rows).join(meta, "chunk_id")))
    return context.within_budget(blocks, 500, 1.1)


@query
def context_budget(spark, d):
    return _budgeted(spark, d).select("query_id", "block", "kept")


@query
def context_render(spark, d):
    return context.render(_budgeted(spark, d)).select("query_id", "n", "label", "token_count", "low_quality", F.size("chunk_ids").alias("chunks"), F.md5("text").alias("text_md5"))


@query
def normalize_text(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.md5(normalize(F.col("text"), unicode_form=True)).alias("norm_md5"))


@query
def clean_blocks(spark, d):
    b = clean.cleaned_blocks(t.blocks(spark, d))
    return b.select("file_id", "block_no", F.md5("clean").alias("clean_md5"), (F.col("clean") == "").alias("blank"))


@query
def clean_boilerplate(spark, d):
    return clean.boilerplate(clean.cleaned_blocks(t.blocks(spark, d))).select("file_id", F.md5("norm").alias("norm_md5"), "pages")


@query
def clean_metrics(spark, d):
    b = clean.cleaned_blocks(t.blocks(spark, d))
    return clean.clean_metrics(b, clean.boilerplate(b)).select("file_id", "original_chars", "cleaned_chars", "removed_chars", "blank_blocks_removed", "header_footer_removed", "retention_ratio")


@query
def clean_signatures(spark, d):
    b = clean.cleaned_blocks(t.blocks(spark, d))
    files = t.files(spark, d).select("file_id")
    listed = clean.with_signatures(files, clean.boilerplate(b))
    return listed.select("file_id", F.size("header_footer_signatures").alias("signatures"), F.md5(F.array_join("header_footer_signatures", "|")).alias("signatures_md5"))


@query
def chunk_sliding(spark, d):
    return t.chunks(spark, d).select("file_id", "chunk_index", "token_count", F.md5("chunk_text").alias("text_md5"))


def _file_chunks(spark, d, strategy):
    return t.file_chunks(spark, d, strategy).select("file_id", "chunk_index", "token_count", "page_number", "section_title", "char_start", "char_end", F.md5("chunk_text").alias("text_md5"))


@query
def chunk_section(spark, d):
    return _file_chunks(spark, d, "section")


@query
def chunk_paragraph(spark, d):
    return _file_chunks(spark, d, "paragraph")


@query
def chunk_min_merge(spark, d):
    """Lines as chunks of their own, merged backward."""
    from docsluice.operators.chunk import merged_chunks

    b = t.blocks(spark, d).where("trim(text) <> ''")
    null = lambda kind: F.lit(None).cast(kind)
    rows = b.select("file_id", F.col("block_no").cast("int").alias("place"), F.lit(False).alias("is_table"), F.col("text").alias("chunk_text"), word_count(F.col("text")).alias("token_count"), F.col("page_no").alias("page_number"), null("string").alias("sheet_name"), null("string").alias("section_title"), null("int").alias("char_start"), null("int").alias("char_end"))
    return merged_chunks(rows, t.LEAST, t.WINDOW).select("file_id", "chunk_index", "token_count", "page_number", F.md5("chunk_text").alias("text_md5"))


def _with_tables(spark, d):
    return t.chunks(spark, d).withColumn("is_table", F.col("chunk_index") % 9 == 8).withColumn("char_start", F.when(F.col("chunk_index") % 2 == 0, 0)).withColumn("char_end", F.lit(1)).withColumn("section_title", F.when(F.col("chunk_index") % 3 == 0, "A"))


@query
def chunk_metrics_by_file(spark, d):
    return chunk_metrics(_with_tables(spark, d), most=t.WINDOW, least=20)


@query
def chunk_metadata_fill(spark, d):
    return metadata_fill(_with_tables(spark, d))


@query
def parse_metrics(spark, d):
    return parse.parse_metrics(t.parsed(spark, d)).select("file_id", "coverage", "page_ratio", "garbage_ratio", "page_count", "char_count", "parse_score")


@query
def injection_scan(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return inject.scan(docs).drop("text")


@query
def injection_scan_pages(spark, d):
    pages = t.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return inject.scan(pages).drop("text")


@query
def qc_chunk_findings(spark, d):
    return quality.chunk_findings(t.chunks(spark, d), least=20, most=60).select("file_id", "chunk_id", "finding")


@query
def quality_score(spark, d):
    return quality.quality_scores(t.metrics(spark, d))


@query
def embed_metrics(spark, d):
    out = embed.embed_metrics(t.vectors(spark, d), "label", 64)
    return out.select("label", "expected", "embedded", "failed", F.round("norm_mean", 5).alias("norm_mean"), F.round("norm_std", 5).alias("norm_std"), "embed_score")


@query
def embed_anomaly(spark, d):
    return embed.mean_pairwise_cosine(t.vectors(spark, d), "label", "chunk_id", 64).withColumn("mean_cosine", F.round("mean_cosine", 6))


@query
def orphan_vectors(spark, d):
    labelled = t.table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))
    return embed.orphans(t.vectors(spark, d), labelled).select("chunk_id", "label")


@query
def report_status(spark, d):
    return report.status_counts(t.files(spark, d))


@query
def report_parse_rate(spark, d):
    return report.parse_rate(t.files(spark, d), t.metrics(spark, d))


@query
def report_step_avg(spark, d):
    return report.step_durations(t.files(spark, d), t.metrics(spark, d))


@query
def report_chunk_stats(spark, d):
    return report.chunk_stats(t.files(spark, d), t.chunks(spark, d))


@query
def report_quality_dist(spark, d):
    return report.quality_distribution(t.files(spark, d))


@query
def report_lowest(spark, d):
    return report.lowest_scores(t.files(spark, d))


@query
def report_open_findings(spark, d):
    found = quality.chunk_findings(t.chunks(spark, d), least=20, most=60)
    return report.open_findings(t.files(spark, d), found.withColumn("resolved", F.col("chunk_id") % 3 == 0))


@query
def report_cross_dupes(spark, d):
    return report.cross_file_duplicates(t.files(spark, d), t.chunks(spark, d))


@query
def report_recovered(spark, d):
    return report.recovered(t.files(spark, d), t.metrics(spark, d))


def _evidence(spark, d):
    b = t.table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.lit(0).alias("evidence_no"), F.col("text").alias("quote"), F.concat(F.lit("doc_"), (F.col("item_id") * 7 % 100).cast("string")).alias("file_name"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("doc_scope"))


def _gold(spark, d):
    return evaluate.map_gold(_evidence(spark, d).select("id", "evidence_no", "quote"), t.whole_chunks(spark, d).select("chunk_id", "chunk_text_norm"), [])


@query
def eval_gold_map(spark, d):
    return _gold(spark, d).select("id", "chunk_id")


@query
def eval_mapping_rate(spark, d):
    return evaluate.mapping_rate(_evidence(spark, d), _gold(spark, d))


@query
def eval_validate_evidence(spark, d):
    return evaluate.check_evidence(_evidence(spark, d), t.files(spark, d), t.whole_chunks(spark, d)).select("id", "file_exists", "quote_found")


def _measured(spark, d):
    gold = _gold(spark, d)
    questions = t.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"))
    ranked = gold.select("id", "chunk_id", (1 + (F.col("id") + F.col("chunk_id")) % 12).alias("rank"))
    return evaluate.query_metrics(questions, gold, ranked)


@query
def eval_metrics(spark, d):
    m = _measured(spark, d)
    return m.select(*("id", "category"), *(F.round(c, 6).alias(c) for c in m.columns[2:]))


@query
def eval_aggregate(spark, d):
    m = evaluate.aggregated(_measured(spark, d))
    return m.select("category", "n", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")


@query
def eval_dense_run(spark, d):
    """The dense retriever measured: every 50th vector asks; its gold are the others of its label among the 50 rows
    from it on."""
    chunks, vectors, files, _ = _search(spark, d)
    e = t.table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    pool = retrieve.rerank_pool(10)
    found = retrieve.search_dense_batch(chunks, vectors, files, asked.select(F.col("id").alias("query_id"), "vector"), [f"src{i}" for i in range(20)], pool)
    gold = asked.join(e, (F.floor(F.col("vec_id") / 50) * 50 == F.col("id")) & (asked["label"] == e["label"]) & (F.col("vec_id") != F.col("id"))).select("id", F.col("vec_id").alias("chunk_id"))
    questions = asked.select("id", F.concat(F.lit("l"), F.col("label").cast("string")).alias("category"))
    m = evaluate.query_metrics(questions, gold, found.select(F.col("query_id").alias("id"), "chunk_id", "rank"))
    return m.select("id", "category", *(F.round(c, 6).alias(c) for c in m.columns[2:]))


@query
def parse_language(spark, d):
    return t.table(spark, d, "documents").select("doc_id", detect_language("text").alias("language"))


def _claims(spark, d):
    """Each answer with four citations: its first sentence with its first 20 characters as quote, a quote that
    is made up, an id that is none, and a chunk that isn't there."""
    a = t.answers(spark, d)
    first = F.coalesce(F.try_element_at(sentences(F.col("answer")), F.lit(1)), F.lit(""))
    own = F.col("answer_id").cast("string")
    c = lambda n, claim, chunk, quote: F.struct(F.lit(n).alias("n"), claim.alias("claim"), chunk.alias("chunk_id"), quote.alias("quote"))
    bad = F.col("answer_id") % 3
    cites = F.array_compact(F.array(
        c(1, first, own, F.substring("answer", 1, 20)), F.when(bad == 1, c(2, first, own, F.lit("no such quote"))),
        F.when(bad == 1, c(3, first, F.lit("x1"), F.lit(""))), F.when(bad == 2, c(4, first, F.lit("-7"), F.lit(""))),
    ))
    context_rows = a.select("answer_id", F.col("answer_id").alias("chunk_id"), F.col("answer").alias("chunk_text"))
    return a, a.select("answer_id", F.explode(cites).alias("c")).select("answer_id", "c.*"), context_rows


@query
def grounding_validate(spark, d):
    out = ground.validate(*_claims(spark, d), threshold=0.3)
    return out.select("answer_id", F.round("coverage", 6).alias("coverage"), F.array_join("issues", ";").alias("issues"), "passed", ground.confidence(F.col("coverage"), F.lit(0)).alias("confidence"))


@query
def sentence_coverage(spark, d):
    a = t.answers(spark, d)
    first = F.slice(F.transform(sentences(F.col("answer")), lambda s: normalize(s)), 1, 2)
    return a.select("answer_id", F.size(sentences(F.col("answer"))).alias("sentences"), F.round(ground.coverage(F.col("answer"), first), 6).alias("coverage"))


@query
def compose_sources(spark, d):
    _, cites, ctx = _claims(spark, d)
    known = ctx.select("answer_id", "chunk_id", F.concat(F.lit("answer_"), F.col("chunk_id").cast("string")).alias("file_name"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section_title"))
    return ground.sources(cites, known).select("answer_id", "n", "file_name", "page_number", "chunk_id", "quote")


@query
def session_history(spark, d):
    c = t.table(spark, d, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", n.alias("n"), "role", F.md5("text").alias("text_md5"))


def _taken(spark, d):
    """Files with a label are known; then all documents arrive, and each again with its content changed."""
    docs = t.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), "n_chars")
    known = docs.join(t.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file_name"), "checksum", F.lit(1).alias("doc_version"))
    same = docs.select((F.col("doc_id") * 2).alias("arrival_no"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file_name"), F.when(F.col("doc_id") % 11 != 5, "txt").alias("file_type"), "checksum", F.when(F.col("doc_id") % 13 == 4, 200 << 20).otherwise(F.col("n_chars")).alias("file_size"))
    changed = docs.select((F.col("doc_id") * 2 + 1).alias("arrival_no"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file_name"), F.lit("txt").alias("file_type"), F.sha2(F.concat("checksum", F.lit("2")), 256).alias("checksum"), F.col("n_chars").alias("file_size"))
    return intake.intake(same.union(changed), known)


@query
def intake_dedup_version(spark, d):
    return _taken(spark, d).select("arrival_no", "outcome", "doc_version")


@query
def intake_outcomes(spark, d):
    return intake.outcome_counts(_taken(spark, d))


@query
def retry_select(spark, d):
    return intake.requeued(intake.retryable(t.files(spark, d).withColumn("fail_reason", F.lit("x")))).select("file_id", "status", "retry_count")


@query
def stuck_recover(spark, d):
    return intake.requeued(intake.stuck(t.files(spark, d), datetime(2024, 1, 15))).select("file_id", "status", "retry_count")


@query
def ingest_states(spark, d):
    """What waits or is stuck, through the gates of parsing and cleaning."""
    due = ingest.due(t.files(spark, d).withColumn("fail_reason", F.lit(None).cast("string")), datetime(2024, 1, 15))
    blocks = clean.cleaned_blocks(t.blocks(spark, d).join(due.select("file_id"), "file_id", "left_semi"))
    parsed = t.parsed(spark, d).join(due.select("file_id"), "file_id", "left_semi")
    cleaned = clean.clean_metrics(blocks, clean.boilerplate(blocks))
    return ingest.gated(due, parse.parse_flags(parse.parse_metrics(parsed)), clean.clean_flags(cleaned)).select("file_id", "status", "fail_reason", "retry_count")


@query
def reprocess_point(spark, d):
    return intake.reprocess_from(t.metrics(spark, d))


@query
def score_backfill(spark, d):
    return quality.backfilled(t.files(spark, d), t.metrics(spark, d)).select("file_id", F.col("quality_score").cast("double").alias("quality_score"))


@query
def golden_load(spark, d):
    """The test items as a golden set: written as JSON lines, read, loaded twice; the second time nothing changes."""
    root = t.work_folder(spark, "golden")
    b = t.table(spark, d, "benchmark")
    e = F.array(F.struct(F.lit("a.txt").alias("file_name"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("sheet"), F.col("text").alias("quote")))
    rows = b.select(F.col("item_id").cast("string").alias("id"), F.concat_ws(" ", F.lit("q"), F.col("item_id").cast("string")).alias("question"), F.lit("").alias("ideal_answer"), F.lit("single_fact").alias("category"), F.lit(1).alias("difficulty"), e.alias("gold_evidence"), F.lit("default").alias("doc_scope"), F.lit(True).alias("answerable"), F.lit("").alias("created_by"), F.lit("").alias("notes"))
    rows.write.mode("overwrite").json(f"{root}/in")
    golden = read_golden(spark, f"{root}/in")
    done = [load_golden(spark, golden, "v1", f"{root}/store") for _ in range(2)]
    stored = spark.read.parquet(f"{root}/store/records")
    return stored.select("id", "question", F.size("gold_evidence").alias("evidences"), F.lit(json.dumps(done)).alias("outcomes"))


@query
def golden_faults(spark, d):
    """The test items as golden sets, a file for each hundred of them, some lines of which are broken: which, and how."""
    root = t.work_folder(spark, "faults")
    i, text = F.col("item_id"), F.col("text")
    evidence = F.array(F.struct(F.lit("a.txt").alias("file_name"), F.when(i % 11 != 3, 1).alias("page"), F.lit(None).cast("string").alias("sheet"), text.alias("quote")))
    fields = {"id": F.when(i % 13 == 5, F.lit("same")).otherwise(i.cast("string")), "question": F.concat_ws(" ", F.lit("q"), i.cast("string")), "ideal_answer": F.lit(""), "category": F.when(i % 17 == 4, "odd").otherwise("single_fact"), "difficulty": F.lit(1), "gold_evidence": evidence, "doc_scope": F.lit("default"), "answerable": F.lit(True), "extra": F.when(i % 7 == 2, "x")}
    record = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    line = F.when(i % 19 == 1, F.concat(F.lit("not json "), i.cast("string"))).otherwise(record)
    rows = t.table(spark, d, "benchmark").select("item_id", F.floor(i / 100).alias("part"), F.when(i % 5 == 0, F.concat(F.lit("\n"), line)).otherwise(line).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "item_id").drop("item_id").write.partitionBy("part").text(f"{root}/in")
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return read_faults(spark, f"{root}/in").select(part.alias("part"), "line", "problem")


@query
def injection_spans(spark, d):
    """Where in the documents patterns of the caller's match: licences, addresses, rights."""
    patterns = (r"licen[cs]ed?\s+[a-z]+", r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", r"all\s+rights\s+reserved")
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("id", F.explode(inject.pattern_spans(F.col("text"), patterns)).alias("s")).select("id", "s.*")


def _pairs(spark, d):
    """Character pairs of the documents whose number mod 4 isn't 2."""
    return learn_pairs(t.table(spark, d, "documents").where("doc_id % 4 <> 2"))


@query
def charset_detect(spark, d):
    """Every document's text in one of seven encodings, read by the learned pairs: whether it is what it was."""
    names = ("utf-8", "cp1252", "mac-roman", "cp850", "iso8859-2", "cp437", "utf-16")
    encode = F.pandas_udf(lambda text, i: pd.Series([None if x is None else _encoded(x, names[n % len(names)]) for x, n in zip(text, i, strict=True)]), "binary")
    docs = t.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = docs.withColumn("back", decoded(_pairs(spark, d))(encode("text", "doc_id")))
    return told.select("doc_id", (F.col("doc_id") % 4 == 2).alias("held_out"), (F.col("back") == F.col("text")).alias("right"))


def _encoded(text: str, name: str) -> bytes:
    """In this encoding, or in UTF-8 where it lacks a character."""
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        return text.encode()


@query
def encoding_repair(spark, d):
    """Every document's text read in a wrong code page (two thirds of them), repaired: whether it is what it was."""
    wrong = ("cp1252", "mac-roman", "latin-1", "cp850")
    spoil = F.pandas_udf(lambda text, i: pd.Series([x if n % 3 == 0 else x.encode().decode(wrong[n % len(wrong)], "ignore") if wrong[n % len(wrong)] != "cp1252" else x.encode("mac-roman", "ignore").decode("cp850") for x, n in zip(text, i, strict=True)]), "string")
    docs = t.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = docs.withColumn("back", repaired(_pairs(spark, d))(spoil("text", "doc_id")))
    return told.select("doc_id", (F.col("doc_id") % 4 == 2).alias("held_out"), (F.col("doc_id") % 3 != 0).alias("spoilt"), (F.col("back") == F.col("text")).alias("right"))


@query
def stream_intake(spark, d):
    """All documents through a file stream, each content once: held against what is stored, without state."""
    root = t.work_folder(spark, "stream")
    docs = t.table(spark, d, "documents")
    docs.write.mode("overwrite").parquet(f"{root}/in")
    stream = file_stream(spark, f"{root}/in", docs.schema, per_batch=8)
    run_available(stream, into_store(f"{root}/taken", ["doc_id"], "doc_id"), f"{root}/state").awaitTermination()
    return spark.read.schema("checksum string").parquet(f"{root}/taken").select("checksum")


@query
def ingest_run(spark, d):
    """What is due, from parsed documents to published chunks: first while the embedder is out, which publishes nothing, then in
    three lots. Files with their state and number of chunks."""
    root = f"{t.work_folder(spark, 'ingest')}/store"
    files = t.files(spark, d).drop("checksum").withColumn("fail_reason", F.lit(None).cast("string"))
    args = {"dim": 8, "now": datetime(2024, 1, 15), "strategy": "sliding", "most": t.WINDOW, "overlap": t.OVERLAP, "least": t.LEAST}
    try:
        ingest.run(files, t.parsed(spark, d), embed.Down, root, **args)
    except embed.Unreachable:
        assert Snapshots(spark, root).tables() == ["files"]
    published = ingest.run(files, t.parsed(spark, d), lambda: embed.HashEmbedder(8), root, lot=max(1, files.count() // 8), **args)
    chunks = Snapshots(spark, root).read("chunks").groupBy("file_id").agg(F.count("*").alias("chunks"))
    return published.join(chunks, "file_id", "left").select("file_id", "status", "fail_reason", F.col("retry_count").cast("int").alias("retry_count"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
