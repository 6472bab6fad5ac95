"""A training corpus in five stages, each an operator of docsluice.llm over all documents that are left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.llm.bpe import bpe_round_trip
from docsluice.llm.common import Scratch
from docsluice.llm.decontaminate import drop_contaminated
from docsluice.llm.language_id import fit_language_filter, identify_language
from docsluice.llm.set_join import one_of_each_group
from docsluice.llm.suffix_dedup import drop_repeats

#: A document is rejected below this share of n-grams that belong to its language.
LEAST_LANGUAGE_SCORE = 0.5
#: Passages of over 50 words of prose have more bytes than this. Runs of very short words may not, and then stay:
#: on sf0.1, 166 of 9,514 documents of 51 words or more have 51 words in fewer bytes (101 at least), and 96 of them
#: share such a run with another document.
REPEAT_BYTES = 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; `und` (a null text or one without a letter) and doubtful ones go. The filter is
    learned from the rows with a lang; with none, all stay. Repeated rows and very long texts are judged like others;
    other columns, of any names, are handed on."""
    model = fit_language_filter(docs)
    if not model.languages:
        return docs
    lang, score = f"lang_{model.key}", f"score_{model.key}"  # names that no column has
    told = identify_language(docs, model, lang_out=lang, score_out=score)
    return told.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(lang, score)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id. Null, empty and wordless texts are
    groups of their own and stay, rows with a null id stay, rows equal in id and text become one."""
    return one_of_each_group(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages that other documents have; the copy under the smallest id stays (of
    equal ids, by a hash of the text). n_chars follows the text. Null and empty texts stay as they are; a document
    of which nothing is left goes."""
    return drop_repeats(docs, least=REPEAT_BYTES)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item, up to one edit in five words. Null and empty texts and items match nothing;
    rows repeated in the input are judged alike."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: doc_id, their number and digests of the ids and of the decoded text; a null or empty
    text has none. One row for each row of the input."""
    return bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the learned language filter nor the merges of BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again; what the stage before wrote is deleted
    then. An empty table gives an empty result. The last stage's rows stay in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        written = Scratch(spark)
        docs = written.saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.close()
        before = written
    return docs
