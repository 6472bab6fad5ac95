"""Ingestion from end to end: what waits is parsed, cleaned, chunked, embedded and stored, file by file a state.

A run works through lots of files, each of which is one version of the store. A file that fails a gate is FAILED with its
reason and holds nobody up. When the embedder can't be reached nothing of that lot is published: its files wait as
before, without a retry counted, and the run ends with `Unreachable`; the lots before stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions.vectors import is_bad
from docsluice.operators import clean, intake, parse
from docsluice.operators.chunk import MAX_TOKENS, MIN_TOKENS, OVERLAP, chunk_files
from docsluice.operators.embed import Embedder, Unreachable, embed
from docsluice.operators.snapshots import Snapshots
from docsluice.operators.store import chunk_id, metric_rows
from docsluice.sources.files import tables_of

#: Indexes of failed chunks that a file's embedding row lists.
FAILED_LISTED = 50


def due(files: DataFrame, now: datetime | None = None, limit: int | None = None) -> DataFrame:
    """Files to process: those that wait and, given the time, those stuck in processing (one more retry), in the
    order of their ids."""
    if now is not None:
        files = intake.requeued(intake.stuck(files, now)).unionByName(files.where("status = 'PENDING'"), allowMissingColumns=True)
    return intake.pending(files, limit)


def gated(files: DataFrame, parsed: DataFrame, cleaned: DataFrame) -> DataFrame:
    """files: file_id. Adds `status` (PROCESSING, or FAILED at the first gate that a file doesn't pass) and
    `fail_reason`. parsed and cleaned are the metrics of the two steps with hard_fail; a file without parse metrics is
    FAILED, one without clean metrics had nothing to clean away."""
    p = parsed.select("file_id", F.col("hard_fail").alias("__parse"))
    c = cleaned.select("file_id", F.col("hard_fail").alias("__clean"))
    reason = F.when(F.col("__parse").isNull(), "parse: no result").when(F.col("__parse"), "parse: coverage or junk beyond the limit").when(F.col("__clean"), "clean: too little is left")
    out = files.join(p, "file_id", "left").join(c, "file_id", "left").withColumn("fail_reason", reason)
    return out.withColumn("status", F.when(F.col("fail_reason").isNull(), "PROCESSING").otherwise("FAILED")).drop("__parse", "__clean")


def blocks_of(parsed: DataFrame) -> DataFrame:
    """file_id, page_no, block_no (from 1, through the file) and text of parsed documents."""
    flat = F.flatten(F.transform("pages", lambda p: F.transform(p["text_blocks"], lambda b: F.struct(p["page_no"].alias("page_no"), b.alias("text")))))
    return parsed.select("file_id", F.posexplode(flat).alias("i", "b")).select("file_id", "b.page_no", (F.col("i") + 1).alias("block_no"), "b.text")


def embed_results(vectors: DataFrame, dim: int) -> DataFrame:
    """vectors: file_id, chunk_index, embedding. Per file: expected and failed vectors, the first failed indexes, and
    the finding `embedding_failed` where there are any."""
    bad = is_bad(F.col("embedding"), dim)
    counts = vectors.groupBy("file_id").agg(F.count("*").alias("expected"), F.count_if(bad).alias("failed"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("chunk_index"))
    first = vectors.where(bad).select("file_id", "chunk_index").withColumn("__n", place).where(F.col("__n") <= FAILED_LISTED)
    listed = first.groupBy("file_id").agg(F.sort_array(F.collect_list("chunk_index")).alias("failed_indexes"))
    return counts.join(listed, "file_id", "left").select("file_id", "expected", "failed", F.coalesce("failed_indexes", F.array().cast("array<int>")).alias("failed_indexes"), F.when(F.col("failed") > 0, "embedding_failed").alias("finding"))


def run(
    files: DataFrame, parsed: DataFrame, make: Callable[[], Embedder], root: str, *, dim: int, now: datetime | None = None, limit: int | None = None, lot: int | None = None,
    strategy: str = "section", most: int = MAX_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS,
) -> DataFrame:
    """Process what is due and publish chunks, vectors, tables, embedding results, metrics and statuses in the store below `root`; returns
    the table of files as published.

    files: as they are now; those that the store hasn't got are entered first. parsed: documents of the files (`schema.PARSED` and
    file_type). lot: about so many files a version (all in one, if None). Vectors that are null or broken are not stored; their chunks are. What the
    embedder answered is written before anything is published, so that an outage leaves the store as it was."""
    spark = files.sparkSession
    store = Snapshots(spark, root)
    if "files" not in store.tables():
        store = store.commit({"files": files}, files)
    else:
        new = files.join(store.read("files").select("file_id"), "file_id", "left_anti")
        store = store if new.isEmpty() else store.commit({"files": new}, new)
    these = due(files, now, limit)
    lots = max(1, -(-these.count() // lot)) if lot else 1
    step = f"{store.root}/steps/{uuid.uuid4().hex}"
    these.withColumn("__lot", F.pmod(F.xxhash64("file_id"), F.lit(lots))).write.parquet(f"{step}/due")
    for i in range(lots):
        own = spark.read.parquet(f"{step}/due").where(F.col("__lot") == i).drop("__lot")
        store = _publish(store, own, parsed, make, f"{step}/{i}", dim, strategy, most, overlap, least)
    return store.read("files")


def _publish(store: Snapshots, these: DataFrame, parsed: DataFrame, make: Callable[[], Embedder], step: str, dim: int, strategy: str, most: int, overlap: int, least: int) -> Snapshots:
    """One lot, from its parsed documents to a version of the store. step: a folder of its own."""
    spark = store.spark
    docs = parsed.join(these.select("file_id"), "file_id", "left_semi")
    blocks = clean.cleaned_blocks(blocks_of(docs))
    signatures = clean.boilerplate(blocks)
    measured, cleaned = parse.parse_flags(parse.parse_metrics(docs)), clean.clean_flags(clean.clean_metrics(blocks, signatures))
    gated(these, measured, cleaned).write.parquet(f"{step}/gated")
    through = spark.read.parquet(f"{step}/gated")  # all that follows asks for it
    going = through.where("status = 'PROCESSING'").select("file_id")
    kept = clean.kept_blocks(blocks, signatures).join(going, "file_id", "left_semi").select("file_id", "page_no", "block_no", F.col("clean").alias("text"))
    docs = docs.join(going, "file_id", "left_semi")
    sections = docs.select("file_id", F.posexplode("sections").alias("section_no", "s")).select("file_id", "section_no", "s.title")
    tables = tables_of(docs)
    chunks = chunk_files(kept, sections, tables, strategy=strategy, most=most, overlap=overlap, least=least)
    embedded = embed(chunks.withColumn("chunk_id", chunk_id(F.col("file_id"), F.col("chunk_index"))), make)
    try:
        embedded.write.parquet(f"{step}/embedded")
    except Exception as e:
        if Unreachable.__name__ in str(e):
            raise Unreachable("the embedder can't be reached; the files of this lot wait as before") from e
        raise
    stored = spark.read.parquet(f"{step}/embedded")
    ended = through.withColumn("status", F.when(F.col("status") == "PROCESSING", "COMPLETED").otherwise(F.col("status")))
    vectors = stored.where(~is_bad(F.col("embedding"), dim)).select("file_id", "chunk_id", "embedding")
    results = embed_results(stored, dim)
    steps = (metric_rows(measured, "parse", ["parse_score"], ok=~F.col("hard_fail")), metric_rows(cleaned, "clean", ["retention_ratio"], ok=~F.col("hard_fail")), metric_rows(results, "embed", ["expected", "failed"], ok=F.col("failed") == 0))
    new = {"chunks": stored.drop("embedding"), "vectors": vectors, "tables": tables, "embed_results": results, "metrics": steps[0].union(steps[1]).union(steps[2]), "files": ended}
    return store.commit(new, through)


def reintake(failed: DataFrame, found: DataFrame, allowed: tuple[str, ...], max_mb: int = intake.MAX_FILE_MB) -> DataFrame:
    """Files that failed at intake against what is at their source_path now (found: source_path, file_type, checksum,
    file_size). A supported content within the limit waits again under its new checksum, without a retry counted;
    else the file stays FAILED with the reason."""
    new = found.select("source_path", *(F.col(c).alias(f"__{c}") for c in ("file_type", "checksum", "file_size")))
    reason: Column = (
        F.when(F.col("__checksum").isNull(), "reintake: no file at its path")
        .when(F.col("__file_type").isNull() | ~F.col("__file_type").isin(*allowed), "reintake: unsupported type")
        .when(F.col("__file_size") > max_mb * 1024 * 1024, f"reintake: larger than {max_mb} MB")
    )
    out = failed.join(new, "source_path", "left").withColumn("fail_reason", reason)
    well = F.col("fail_reason").isNull()
    for c in ("file_type", "checksum", "file_size"):
        out = out.withColumn(c, F.when(well, F.col(f"__{c}")).otherwise(F.col(c))).drop(f"__{c}")
    return out.withColumn("status", F.when(well, "PENDING").otherwise("FAILED")).select(*failed.columns, *(c for c in ("fail_reason",) if c not in failed.columns))
