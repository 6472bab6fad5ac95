"""A stored positional index: which chunks have a term, how often and where. Searches read the asked terms' folders only.

One row is a block: a term's postings in one slice of the chunks, with the largest count (`best`) as a column of
its own, so that blocks which can't reach the k-th score are skipped before their lists are read. Postings name chunks by
their place in the slice, whose ids are one more row (in the folder `DIRECTORY`); lists ascend, and Parquet's second format stores
ascending numbers as bit-packed differences. Searches are column functions, but for the exact trigram similarity.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.functions.lexical import trigrams
from docsluice.functions.text import fold_accents, lexemes

#: Chunks of a slice, text of a file, folders at most, blocks of the first look.
SLICE_CHUNKS, FILE_BYTES, MOST_BUCKETS, FIRST_BLOCKS = 2048, 64 << 20, 1024, 64
#: Occurrences of a block from which it is one of a frequent term, and the tasks at least (if there are so many) that share those of a bucket.
HEAVY, LEAST_SPREAD = 2048, 16
#: Flags that tell trigrams and chunks apart without sorting them, where that many are enough.
MOST_FLAGS = 1 << 26
#: Characters of texts that are compared with a query in one step.
STEP_CHARS = 1 << 20
KINDS = ("words", "trigrams")
DIRECTORY = -1
_LISTS = "rows array<smallint>, counts array<int>, place_rows array<smallint>, places array<int>, chunk_ids array<bigint>, file_ids array<bigint>"
BLOCKS = f"term string, folded string, slice bigint, n bigint, occurrences bigint, best int, {_LISTS}, bucket int"


class Postings(NamedTuple):
    blocks: DataFrame
    buckets: int
    kind: str


def _in_bucket(folded: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(folded), F.lit(buckets)).cast("int")


def _writer(bucket: Column, buckets: int, parts: int) -> Column:
    """The number of the task, of buckets * parts, that writes a block. A bucket has `parts` tasks of its own, which no hash deals
    to one another's; blocks of frequent terms, of which a bucket may have any amount, go to more of them by a hash of the
    slice, and the directory's rows to all."""
    tasks = buckets * parts
    spread = max(min(tasks, LEAST_SPREAD), -int(-(tasks**0.5) // 1))
    by_slice = lambda n: F.pmod(F.xxhash64("slice"), F.lit(n)).cast("int")
    heavy = F.coalesce(F.size("places"), F.size("rows")) >= HEAVY
    within = F.when(heavy, by_slice(spread)).otherwise(by_slice(parts))
    return F.when(bucket == DIRECTORY, by_slice(tasks)).otherwise(F.pmod(bucket * parts + within, F.lit(tasks))).cast("int")


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive parts of an array as lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _of_words(words: list[str], code: np.ndarray, row: np.ndarray, rows: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct (word, row) pairs to the distinct (trigram, row) pairs: the trigrams, and both by trigram and row."""
    number: dict[str, int] = {}
    own = [[number.setdefault(g, len(number)) for g in dict.fromkeys(trigrams(w))] for w in words]
    size = np.array([len(x) for x in own], np.int64)
    flat, begin, each = np.fromiter((g for x in own for g in x), np.int32, int(size.sum())), np.cumsum(size) - size, size[code]
    # the numbers from each word's first trigram on: ones, but for the step to the next word's
    step = np.ones(int(each.sum()), np.int32)
    ends = np.cumsum(each)
    step[0], step[ends[:-1]] = begin[code[0]], begin[code[1:]] - begin[code[:-1]] - each[:-1] + 1
    gram, row = flat[np.cumsum(step, dtype=np.int32)], np.repeat(row.astype(np.int32), each)
    del step
    if len(number) * rows <= MOST_FLAGS:
        there = np.zeros(len(number) * rows, bool)
        gram *= rows
        gram += row
        there[gram] = True
        key = np.flatnonzero(there)
    else:
        key = np.unique(gram.astype(np.int64) * rows + row)
    return list(number), key // rows, key % rows


def _inverted(batch: pa.RecordBatch, slice_no: int, kind: str) -> pa.RecordBatch:
    """The blocks of a slice, and its directory row: chunks (chunk_id, file_id, items: their words) by ascending id."""
    table = pa.Table.from_batches([batch])
    table = table.filter(pc.greater(pc.list_value_length(table["items"]), 0)).sort_by("chunk_id").combine_chunks()
    items = table["items"].combine_chunks()
    lengths = pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = items.flatten().dictionary_encode()
    code, row, terms = coded.indices.to_numpy(), np.repeat(np.arange(len(lengths)), lengths), coded.dictionary
    order = np.argsort(code, kind="stable")  # within a term by row and place
    code, row = code[order], row[order]
    begin = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])])  # of each posting
    counts = np.diff(np.r_[begin, len(code)])
    place_rows, place = row, (np.arange(len(order)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[order]
    code, row = code[begin], row[begin]
    if kind == "trigrams":
        words, code, row = _of_words(terms.to_pylist(), code, row, len(lengths))
        terms, counts = pa.array(words, pa.string()), np.ones(len(code), np.int64)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])  # of each term
    ends, n = np.r_[first[1:], len(code)], len(first)
    lists = [_lists(row.astype(np.int16), ends, pa.int16()), *(pa.nulls(n, pa.list_(x)) for x in (pa.int32(), pa.int16(), pa.int32()))]
    if kind == "words":
        last = np.cumsum(counts)[ends - 1]
        lists[1:] = [_lists(counts.astype(np.int32), ends, pa.int32()), _lists(place_rows.astype(np.int16), last, pa.int16()), _lists(place.astype(np.int32), last, pa.int32())]
    ids = [_lists(table[c].to_numpy(), np.array([len(table)]), pa.int64()) for c in ("chunk_id", "file_id")]
    blocks = [terms.take(pa.array(code[first])).cast(pa.string()), pa.array(np.full(n, slice_no)), *lists, *(pa.nulls(n, x.type) for x in ids)]
    directory = [pa.nulls(1, pa.string()), pa.array([slice_no], pa.int64()), *(pa.nulls(1, x.type) for x in blocks[2:6]), *ids]
    names = ["term", "slice", "rows", "counts", "place_rows", "places", "chunk_ids", "file_ids"]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(blocks, directory, strict=True)], names)


def write_postings(chunks: DataFrame, path: str, kind: str = "words", *, slice_chunks: int = SLICE_CHUNKS, file_bytes: int = FILE_BYTES) -> Postings:
    """Index chunks (chunk_id, file_id, chunk_text_norm) below `path`. They must come in the same order when a task is run
    again: read from files, or written first.

    Terms are words (`lexemes`), with their places from 0, or their trigrams, without (a chunk has nearly as many as
    letters). A task inverts the chunks of one slice at a time, as arrays; one exchange is all, and its rows are whole blocks, dealt by
    `_writer`. Null and empty texts have no postings. `best` is the largest count of a block."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    spark = chunks.sparkSession
    size = chunks.agg(F.sum(F.octet_length("chunk_text" if "chunk_text" in chunks.columns else "chunk_text_norm"))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    buckets = max(16, min(MOST_BUCKETS, files))
    parts = -(-files // buckets)
    tokens = lexemes(F.coalesce("chunk_text_norm", F.lit("")))
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("file_id").cast("long").alias("file_id"), tokens.alias("items"))

    def invert(batches):
        begin = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), slice_chunks):
                part = batch.slice(at, slice_chunks)
                if pc.any(pc.greater(pc.list_value_length(part.column("items")), 0)).as_py():
                    yield _inverted(part, begin, kind)
                begin += 1

    blocks = rows.mapInArrow(invert, f"term string, slice bigint, {_LISTS}")
    # most terms are rare, so a block is a short row: what follows from its lists is added behind the exchange
    bucket = F.when(F.col("term").isNull(), DIRECTORY).otherwise(_in_bucket(fold_accents(F.col("term")), buckets))
    blocks = blocks.repartitionById(buckets * parts, _writer(bucket, buckets, parts))
    n = F.size("rows").cast("long")
    blocks = blocks.select(
        "term", fold_accents(F.col("term")).alias("folded"), "slice", n.alias("n"), F.coalesce(F.size("places").cast("long"), n).alias("occurrences"), F.when(F.col("rows").isNotNull(), F.coalesce(F.array_max("counts"), F.lit(1))).alias("best"),
        "rows", "counts", "place_rows", "places", "chunk_ids", "file_ids", bucket.alias("bucket"),
    ).sortWithinPartitions("bucket", "folded", "term", F.desc("best"), "slice")
    writer = blocks.write.partitionBy("bucket").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
    writer.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(json.dumps({"buckets": buckets, "kind": kind}),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return open_postings(spark, path)


def open_postings(spark: SparkSession, path: str) -> Postings:
    told = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Postings(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), told["buckets"], told["kind"])


def blocks_of(index: Postings, terms: Sequence[str], accents: bool = True) -> DataFrame:
    """The blocks of these terms, with the number of the term (`asked`); reads their folders only. Without accents, of all
    terms that fold to them."""
    key = "term" if accents else "folded"
    own = [_in_bucket(fold_accents(F.lit(t)), index.buckets) for t in terms]
    found = index.blocks.where(F.col("bucket").isin(*own) & F.col(key).isin(*terms))
    return found.withColumn("asked", F.array_position(F.array(*map(F.lit, terms)), F.col(key)).cast("int") - 1)


def _directory(index: Postings) -> DataFrame:
    return index.blocks.where(F.col("bucket") == DIRECTORY).select("slice", F.col("chunk_ids").alias("__c"), F.col("file_ids").alias("__f"))


def _ids(rows: DataFrame, index: Postings) -> DataFrame:
    """Rows of (slice, row, ...) with chunk_id and file_id instead."""
    met = rows.join(_directory(index), "slice")
    return met.select(F.get("__c", F.col("row").cast("int")).alias("chunk_id"), F.get("__f", F.col("row").cast("int")).alias("file_id"), *(c for c in rows.columns if c not in ("slice", "row")))


def counted(index: Postings, blocks: DataFrame) -> DataFrame:
    """A row for each posting of the blocks: asked, chunk_id, file_id, count. The directory's rows are joined to blocks, not to postings."""
    met = blocks.select("asked", "slice", "rows", "counts").join(_directory(index), "slice")
    of = lambda ids: F.transform("rows", lambda r: F.get(F.col(ids), r.cast("int")))
    rows = met.select("asked", F.explode(F.arrays_zip(of("__c").alias("chunk_id"), of("__f").alias("file_id"), F.col("counts").alias("count"))).alias("p"))
    return rows.select("asked", "p.*")


def in_order(index: Postings, blocks: DataFrame, terms: int) -> DataFrame:
    """A row for each chunk that has so many terms: chunk_id, file_id, and the terms' places in order (`at`: place, asked)."""
    rows = blocks.select("asked", "slice", F.explode(F.arrays_zip("place_rows", "places")).alias("p")).select("slice", F.col("p.place_rows").alias("row"), F.struct(F.col("p.places").alias("place"), "asked").alias("x"))
    met = rows.groupBy("slice", "row").agg(F.sort_array(F.collect_list("x")).alias("at")).where(F.size(F.array_distinct(F.col("at")["asked"])) == terms)
    return _ids(met, index)


def term_counts(index: Postings) -> DataFrame:
    """term, chunks, occurrences: of all terms, from the blocks' own columns."""
    return index.blocks.where(F.col("bucket") != DIRECTORY).groupBy("term").agg(F.sum("n").alias("chunks"), F.sum("occurrences").alias("occurrences"))


def _last(acc: Column, x: Column) -> Column:
    return F.transform(acc["last"], lambda v, i: F.when(i == x["asked"], x["place"]).otherwise(v))


def cover_score(at: Column, terms: int) -> Column:
    """Cover density of places in order: each shortest stretch that has all terms adds 0.1 times their number over
    one more than the other words in it. To nine digits, so that the order of adding makes no ties."""

    def step(acc: Column, x: Column) -> Column:
        last = _last(acc, x)
        low = F.array_min(last)
        adds = 0.1 * terms / (x["place"] - low + 2 - terms)
        return F.struct(last.alias("last"), F.greatest(acc["start"], low).alias("start"), (acc["score"] + F.when(low > acc["start"], adds).otherwise(0.0)).alias("score"))

    begin = F.struct(F.array_repeat(F.lit(-1), terms).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("score"))
    return F.round(F.aggregate(at, begin, step, lambda acc: acc["score"]), 9)


def words_apart(text: Column) -> Column:
    """The words of a normalised text with two blanks before each and one behind: its trigrams of words stand there one after the other,
    with two places between words that are none."""
    return F.concat(F.lit("  "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\W+", "   ")), F.lit(" "))


def most_in_a_run(asked: Sequence[str], length: int):
    """A function of `words_apart`: the most different asked trigrams that any `length` trigrams in a row of the text have. Over arrays of
    code points; a fold of column functions over each text's trigrams took ten times as long."""
    known = np.sort(np.array([[ord(c) for c in g] for g in asked], np.int64).reshape(-1, 3) @ np.array([1 << 42, 1 << 21, 1], np.int64))

    def of(texts: list[str]) -> np.ndarray:
        out, ends = np.zeros(len(texts), np.int32), np.cumsum([len(t) for t in texts])
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(c) < 3 or not len(known):
            return out
        gram = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        own = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        hit = np.flatnonzero(known[own] == gram)
        text = np.searchsorted(ends, hit, "right")
        inside = hit + 2 < ends[text]  # not from one text to the next
        hit, text = hit[inside], text[inside]
        blank = c == 32
        place, own = hit - 2 * np.cumsum(blank[:-2] & blank[1:-1] & ~blank[2:])[hit], own[hit]
        # where the same trigram comes next in its text: it counts once in a run, as its last place
        order = np.lexsort((np.arange(len(hit)), own, text))
        again = np.full(len(hit), len(hit))
        same = (text[order][1:] == text[order][:-1]) & (own[order][1:] == own[order][:-1])
        again[order[:-1][same]] = order[1:][same]
        there, i = np.zeros(len(hit), np.int32), np.arange(len(hit))
        for back in range(min(length, len(hit))):  # a place has one trigram, so a run has no more
            j = i[: len(i) - back]
            there[back:] += (text[j] == text[back:]) & (place[j] > place[back:] - length) & (again[j] > i[back:])
        np.maximum.at(out, text, there)
        return out

    @F.pandas_udf("int")
    def most(texts: pd.Series) -> pd.Series:
        texts, out, at = texts.tolist(), [np.zeros(0, np.int32)], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= STEP_CHARS):
                chars += len(texts[end])
                end += 1
            out.append(of(texts[at:end]))
            at = end
        return pd.Series(np.concatenate(out))

    return most


Seen = Callable[[DataFrame], DataFrame]


def _best(hits: DataFrame, seen: Seen, k: int) -> list[tuple[int, float]]:
    """The best k rows among those that may be seen; ties by chunk_id. At most k rows come to the driver."""
    return [tuple(r) for r in seen(hits).select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(k).collect()]


def _by_bounds(bounds: DataFrame, hits: Callable[[Column, DataFrame | None], DataFrame], seen: Seen, k: int) -> list[tuple[int, float]]:
    """Exact top k in two looks: the slices of the highest bounds give a k-th score, then all slices that can
    reach it, if there are more. bounds: slice, bound. hits: a condition on slices, or a table of them, to (chunk_id, file_id, score)."""
    first = bounds.orderBy(F.desc("bound"), "slice").limit(FIRST_BLOCKS).collect()  # so many numbers at most
    found = _best(hits(F.col("slice").isin([r["slice"] for r in first]), None), seen, k)
    floor = found[-1][1] - 1e-9 if len(found) == k else None
    if len(first) < FIRST_BLOCKS or floor is not None and first[-1]["bound"] < floor:
        return found
    return _best(hits(F.lit(True), bounds if floor is None else bounds.where(F.col("bound") >= floor)), seen, k)


def top_by_words(index: Postings, words: Sequence[str], seen: Seen, k: int, accents: bool = True) -> list[tuple[int, float]]:
    """The k chunks of the highest cover density among those that have all words: (chunk_id, score).

    seen: keeps the rows (chunk_id, file_id, ...) that the caller may see. The slices are chosen by the word with the fewest
    chunks: a chunk where it stands c times has at most m * c shortest stretches of m words, of 0.1 * m each at most. An
    empty query, and one with a word that no chunk has, find nothing."""
    words = list(dict.fromkeys(words))
    if not words:
        return []
    m, blocks = len(words), blocks_of(index, words, accents)
    rare = 0
    if m > 1:
        sizes = {r["asked"]: r["n"] for r in blocks.groupBy("asked").agg(F.sum("n").alias("n")).collect()}  # a row for each word
        if len(sizes) < m:
            return []
        rare = min(sizes, key=lambda a: (sizes[a], a))
    bounds = blocks.where(F.col("asked") == rare).groupBy("slice").agg((0.1 * (m * m if m > 1 else 1) * F.sum("best")).alias("bound"))

    def hits(where: Column, slices: DataFrame | None) -> DataFrame:
        near = blocks.where(where) if slices is None else blocks.join(slices.select("slice"), "slice", "left_semi")
        if m > 1:
            return in_order(index, near, m).select("chunk_id", "file_id", cover_score(F.col("at"), m).alias("score"))
        rows = counted(index, near)
        if not accents:  # several terms fold to the word
            rows = rows.groupBy("chunk_id", "file_id").agg(F.sum("count").alias("count"))
        return rows.select("chunk_id", "file_id", (F.col("count") * 0.1).alias("score"))

    return _by_bounds(bounds, hits, seen, k)


def top_by_trigrams(index: Postings, chunks: DataFrame, query: str, seen: Seen, k: int, least: float, first: int = 256) -> list[tuple[int, float]]:
    """The k chunks most like the query, as `word_similarity` has it, and at least `least`: (chunk_id, score).

    The trigrams' lists are merged by counting: a run can't have more of the query's trigrams than its chunk, so chunks that are in too
    few lists go before any text is read, and so do those that can't reach the k-th of the `first` likeliest. Only the texts of what is
    left (chunks: chunk_id, chunk_text_norm) are read."""
    asked = sorted({g for w in query.split() for g in trigrams(w)})
    if not asked:
        return []
    n, blocks = len(asked), blocks_of(index, asked)
    able = blocks.select("slice", F.explode("rows").alias("row")).groupBy("slice", "row").agg((F.count("*") / n).alias("most")).where(F.col("most") >= least)
    able = seen(_ids(able, index)).select("chunk_id", "most")

    most = most_in_a_run(asked, n)

    def scored(texts: DataFrame) -> DataFrame:
        return texts.select("chunk_id", (most(words_apart(F.col("chunk_text_norm"))) / n).alias("score")).where(F.col("score") >= least)

    likely = able.orderBy(F.desc("most"), "chunk_id").limit(first + 1).collect()  # so many numbers at most
    texts = chunks.select("chunk_id", "chunk_text_norm")
    found = _best(scored(texts.where(F.col("chunk_id").isin([r["chunk_id"] for r in likely[:first]]))), lambda x: x, k)
    floor = found[-1][1] if len(found) == k else least
    if len(likely) <= first or likely[-1]["most"] < floor:
        return found
    return _best(scored(texts.join(able.where(F.col("most") >= floor), "chunk_id", "left_semi")), lambda x: x, k)
