"""The document model laid over the driver's tables.

A document is a file (name doc_<id>, scope its source), its lines are blocks, twenty lines a page. Statuses,
steps and timestamps, which the tables don't have, are arithmetic on the id, the same in Spark and in SQL.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.functions.text import normalize, word_count
from docsluice.operators.cells import Cells, open_cells, write_cells
from docsluice.operators.chunk import chunk_files, sliding_chunks
from docsluice.operators.postings import Postings, open_postings, write_postings

LINES_A_PAGE = 20
WINDOW, OVERLAP, LEAST = 64, 16, 10
ID_STEP = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; only on one machine a temporary one stands in for it."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared and (told := context._jsc.sc().getCheckpointDir()).isDefined():
        shared = told.get()
    if not shared and "cluster" in context.master or not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared}/{name}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=name)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    status = F.when(i % 10 < 7, "COMPLETED").when(i % 10 == 7, "FAILED").when(i % 10 == 8, "PENDING").otherwise("PROCESSING")
    created = F.timestamp_seconds(F.lit(1704067200) + (i * 3571) % 2592000)
    return d.select(
        i.alias("file_id"), F.concat(F.lit("doc_"), i.cast("string")).alias("file_name"), F.lit("txt").alias("file_type"), F.sha2("text", 256).alias("checksum"), F.col("source").alias("doc_scope"), F.col("lang").alias("language"),
        status.alias("status"), (i % 5).cast("int").alias("retry_count"), F.col("n_chars").alias("file_size"), F.lit(1).alias("doc_version"),
        F.when((i % 10 < 7) & (i % 6 != 0), ((i * 37) % 10000 / 100).cast("decimal(5,2)")).alias("quality_score"), created.alias("created_at"), created.alias("updated_at"),
    )


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as its file's only chunk."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"), normalize(F.col("text")).alias("chunk_text_norm"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section_title"))


#: Stored indexes that this session has written: their folders by application, table folder and kind.
_STORED: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf_dir: str, kind: str, write: Callable[[str], object], read: Callable):
    """An index, written at its first use in a session, and again if somebody has cleared the folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key in _STORED:
        try:
            return read(spark, _STORED[key])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    path = f"{work_folder(spark, kind)}/index"
    write(path)
    _STORED[key] = path
    return read(spark, path)


def postings(spark: SparkSession, sf_dir: str, kind: str = "words") -> Postings:
    """The stored index of all documents' words or trigrams."""
    return _stored(spark, sf_dir, kind, lambda path: write_postings(whole_chunks(spark, sf_dir), path, kind), open_postings)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def cells(spark: SparkSession, sf_dir: str) -> Cells:
    """The stored index of all vectors."""
    return _stored(spark, sf_dir, "cells", lambda path: write_cells(vectors(spark, sf_dir), path), open_cells)


def written(spark: SparkSession):
    """A function that writes a table to the shared folder and reads it again."""
    root = work_folder(spark, "steps")

    def save(df: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One row of 64 numbers."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of all documents."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    out = sliding_chunks(texts, most=WINDOW, overlap=OVERLAP, least=LEAST)
    return out.select((F.col("file_id") * ID_STEP + F.col("chunk_index")).alias("chunk_id"), "file_id", "chunk_index", "chunk_text", normalize(F.col("chunk_text")).alias("chunk_text_norm"), "token_count", (F.floor(F.col("chunk_index") / 4) + 1).cast("int").alias("page_number"), F.lit(None).cast("string").alias("sheet_name"), F.lit(None).cast("string").alias("section_title"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines: file_id, page_no, block_no (both from 1), text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return d.select("file_id", (F.floor(F.col("i") / LINES_A_PAGE) + 1).cast("int").alias("page_no"), (F.col("i") + 1).alias("block_no"), "text")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line of at most 60 characters is a section's title."""
    b = blocks(spark, sf_dir).where("block_no % 7 = 1 and length(text) between 1 and 60")
    return b.select("file_id", F.col("block_no").alias("section_no"), F.col("text").alias("title"))


def file_chunks(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return chunk_files(blocks(spark, sf_dir), sections(spark, sf_dir) if strategy == "section" else None, strategy=strategy, most=WINDOW, overlap=OVERLAP, least=LEAST)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.sort_array(F.collect_list(F.struct("page_no", "text_blocks")))
    b = blocks(spark, sf_dir).groupBy("file_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("block_no", "text")))["text"].alias("text_blocks"))
    none = lambda kind: F.array().cast(kind)
    out = b.groupBy("file_id").agg(pages.alias("pages"))
    tables = none("array<struct<index:int,data:array<array<string>>,flattened_text:string,page_no:int,sheet_name:string>>")
    return out.select("file_id", F.when(F.col("file_id") % 2 == 0, "pdf").otherwise("txt").alias("file_type"), "pages", none("array<struct<title:string,level:int,page_start:int>>").alias("sections"), tables.alias("tables"), none("array<struct<index:int,page_no:int,caption:string>>").alias("figures"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step rows of each document; odd thirds have a first parse that failed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"))
    i = F.col("file_id")
    number = lambda x: x.cast("double")
    row = lambda n, step, ok, ms, **detail: F.struct((i * 10 + n).alias("metric_id"), F.lit(step).alias("step"), ok.alias("ok"), ms.cast("int").alias("duration_ms"), F.to_json(F.struct(*(v.alias(k) for k, v in detail.items()))).alias("detail"))
    yes = F.lit(True)
    rows = F.array(
        row(0, "intake", yes, i % 17, copied=i % 4 != 0), row(1, "parse", i % 3 != 0, i % 101, attempt=F.lit(1), parse_score=number(i % 91)),
        row(2, "parse", yes, i % 103, attempt=F.when(i % 3 == 0, 2).otherwise(1), parse_score=number(i % 97)), row(3, "clean", yes, i % 29, retention_ratio=number(i % 11) / 10),
        row(4, "chunk", yes, i % 31, chunk_score=number(i % 89)), row(5, "embed", i % 13 != 0, i % 211, embed_score=F.when(i % 7 != 0, number(i % 83))),
    )
    return d.select("file_id", F.explode(rows).alias("m")).select("file_id", "m.*")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("words"))
