"""Retrieval: dense, lexical and fused top-k, neighbours, rerank. All tables as DataFrames.

Top-k is exact: filters lie below the limit, the limit runs per partition first, and ranks are given to the
k rows left. With several queries the rank window is limited within each partition before the exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from docsluice.functions.lexical import cover_density, matches, word_similarity
from docsluice.functions.text import fold_accents, lexemes
from docsluice.functions.vectors import cosine
from docsluice.operators.cells import Cells, top_by_cells, top_of_many
from docsluice.operators.postings import Postings, top_by_trigrams, top_by_words

DEFAULT_TOP_K, MAX_TOP_K = 10, 20
VARIANTS = ("simple", "unaccent", "trgm")
STRATEGIES = ("rrf", "weighted")
LEAST_WORD_SIMILARITY = 0.2
#: Rows of an index shard, queries of a lot, and queries that are scored in one step.
SHARD_ROWS, LOT_ROWS, STEP_QUERIES = 20_000, 2_000, 32
#: More than two ways of adding up a cosine of plain numbers differ by.
ROUGH = 1e-9


def effective_top_k(top_k: int | None, default: int = DEFAULT_TOP_K, most: int = MAX_TOP_K) -> int:
    return max(1, min(default if top_k is None else int(top_k), most))


def allowed_scopes(scopes: Sequence[str] | None) -> list[str]:
    return [s for s in scopes or [] if s and s.strip()]


def in_scope(files: DataFrame, scopes: Sequence[str] | None) -> DataFrame:
    """Files of the scopes a caller may see; none without scopes."""
    known = allowed_scopes(scopes)
    return files.where(F.col("doc_scope").isin(known)) if known else files.limit(0)


def metadata_filter(file_type: str | None = None, language: str | None = None, section: str | None = None, date_from: str | date | None = None, date_to: str | date | None = None, created: str = "created_at") -> Column:
    """Equality and inclusive days; empty values ask for nothing."""
    day = lambda x: date.fromisoformat(x) if isinstance(x, str) else x
    parts = [F.lit(True)]
    for name, value in (("file_type", file_type), ("language", language), ("section_title", section)):
        if value:
            parts.append(F.col(name) == value)
    if date_from:
        parts.append(F.to_date(created) >= F.lit(day(date_from)))
    if date_to:
        parts.append(F.to_date(created) <= F.lit(day(date_to)))
    return reduce(lambda a, b: a & b, parts)


def _source() -> Column:
    return F.struct("file_id", "file_name", "page_number", "section_title", "doc_version").alias("source")


def _best(df: DataFrame, score: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), "chunk_id").limit(k)


def _ranked(df: DataFrame, score: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), "chunk_id")))


def candidates(chunks: DataFrame, files: DataFrame, scopes: Sequence[str] | None, where: Column | None = None) -> DataFrame:
    joined = chunks.join(in_scope(files, scopes), "file_id")
    return joined if where is None else joined.where(where)


def dense_scores(chunks: DataFrame, vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    asked = F.array(*(F.lit(float(x)) for x in query))
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id").withColumn("score", cosine(F.col("embedding"), asked)).drop("embedding")


def search_dense(chunks: DataFrame, vectors: DataFrame, files: DataFrame, query: Sequence[float], scopes: Sequence[str] | None, top_k: int | None = DEFAULT_TOP_K, where: Column | None = None, index: Cells | None = None) -> DataFrame:
    """chunk_id, chunk_text, score, rank, source; ties by chunk_id. With a stored `index` the same rows, from the cells that can have them."""
    if index is not None:
        near = top_by_cells(index, query, lambda hits: hits.join(candidates(chunks, files, scopes, where).select("chunk_id"), "chunk_id", "left_semi"), effective_top_k(top_k)) if allowed_scopes(scopes) else []
        return _told(near, chunks, in_scope(files, scopes))
    found = _best(dense_scores(candidates(chunks, files, scopes, where), vectors, query), "score", effective_top_k(top_k))
    return _ranked(found, "score", "rank").select("chunk_id", "chunk_text", "score", "rank", _source())


def lexical_scores(chunks: DataFrame, query: str, variant: str = "simple") -> DataFrame:
    """Chunks that match, with `score`. `query` is normalised text; chunks have chunk_text_norm."""
    if variant not in VARIANTS:
        raise ValueError(f"no such variant: {variant}")
    text = F.col("chunk_text_norm")
    if variant == "unaccent":
        text = fold_accents(text)
        query = _folded(query)
    tokens = lexemes(text)
    asked = list(dict.fromkeys(_words(query)))
    if variant == "trgm":
        return chunks.withColumn("score", word_similarity(query)(tokens)).where(F.col("score") >= LEAST_WORD_SIMILARITY)
    return chunks.withColumn("__tokens", tokens).where(matches(F.col("__tokens"), asked)).withColumn("score", cover_density(asked)(F.col("__tokens"))).drop("__tokens")


def _words(query: str) -> list[str]:
    import re

    return re.findall(r"\w+", query)


def _folded(query: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", query) if not unicodedata.combining(c))


def search_lexical(chunks: DataFrame, files: DataFrame, query: str, scopes: Sequence[str] | None, top_k: int | None = DEFAULT_TOP_K, variant: str = "simple", where: Column | None = None, index: Postings | None = None) -> DataFrame:
    """As `search_dense`, by words or trigrams; with a stored `index` (of trigrams for `trgm`, else of words) only the
    asked terms' postings are read, and of the texts only the k found; without one, all texts."""
    if index is not None:
        return _search_postings(index, chunks, files, query, scopes, effective_top_k(top_k), variant, where)
    found = _best(lexical_scores(candidates(chunks, files, scopes, where), query, variant), "score", effective_top_k(top_k))
    return _ranked(found, "score", "rank").select("chunk_id", "chunk_text", "score", "rank", _source())


def _search_postings(index: Postings, chunks: DataFrame, files: DataFrame, query: str, scopes: Sequence[str] | None, k: int, variant: str, where: Column | None) -> DataFrame:
    if variant not in VARIANTS:
        raise ValueError(f"no such variant: {variant}")
    if index.kind != ("trigrams" if variant == "trgm" else "words"):
        raise ValueError(f"{variant} needs another index than one of {index.kind}")
    allowed = in_scope(files, scopes)

    def seen(hits: DataFrame) -> DataFrame:
        if where is None:
            return hits.join(allowed.select("file_id"), "file_id", "left_semi")
        return hits.join(candidates(chunks, files, scopes, where).select("chunk_id"), "chunk_id", "left_semi")

    if not allowed_scopes(scopes):
        found = []
    elif variant == "trgm":
        found = top_by_trigrams(index, chunks, query, seen, k, LEAST_WORD_SIMILARITY)
    elif variant == "unaccent":
        found = top_by_words(index, _words(_folded(query)), seen, k, accents=False)
    else:
        found = top_by_words(index, _words(query), seen, k)
    return _told(found, chunks, allowed)


def _told(found: list[tuple[int, float]], chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """At most MAX_TOP_K ids and scores, best first, as a search's rows: their texts are looked up by id."""
    ranks = chunks.sparkSession.createDataFrame([(i, s, n) for n, (i, s) in enumerate(found, 1)], "chunk_id long, score double, rank int")
    rows = chunks.where(F.col("chunk_id").isin([i for i, _ in found])).join(allowed, "file_id")
    return rows.join(F.broadcast(ranks), "chunk_id").select("chunk_id", "chunk_text", "score", "rank", _source())


def fuse(dense: DataFrame, sparse: DataFrame, k: int, strategy: str = "rrf", rrf_k: int = 60, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """Full outer join of two ranked lists (chunk_id, score, rank): by reciprocal ranks, or by raw scores."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    a = dense.select("chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    b = sparse.select("chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    if strategy == "rrf":
        part = lambda w, rank: F.coalesce(F.lit(float(w)) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))
        score = part(dense_weight, "dense_rank") + part(sparse_weight, "sparse_rank")
    else:
        part = lambda w, s: F.lit(float(w)) * F.coalesce(F.col(s), F.lit(0.0))
        score = part(dense_weight, "dense_score") + part(sparse_weight, "sparse_score")
    fused = a.join(b, "chunk_id", "full_outer").withColumn("score", score)
    detail = F.struct("dense_score", "sparse_score", "dense_rank", "sparse_rank").alias("detail")
    return _ranked(_best(fused, "score", k), "score", "rank").select("chunk_id", "score", "rank", detail)


def search_hybrid(chunks: DataFrame, vectors: DataFrame, files: DataFrame, vector: Sequence[float], text: str, scopes: Sequence[str] | None, top_k: int | None = DEFAULT_TOP_K, where: Column | None = None, variant: str = "simple", index: Postings | None = None, **fusion) -> DataFrame:
    """Both branches' top k, fused to the top k."""
    k = effective_top_k(top_k)
    dense = search_dense(chunks, vectors, files, vector, scopes, k, where)
    sparse = search_lexical(chunks, files, text, scopes, k, variant, where, index)
    return fuse(dense, sparse, k, **fusion)


def _vectors(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a list column filled up with zeros, their lengths (-1: null or with a null in it), their norms."""
    column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    lengths[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    lengths[column.is_null().to_numpy(zero_copy_only=False)] = -1
    norm = np.zeros(len(lengths))
    for x in out.T:
        norm += x * x
    return out, lengths, np.sqrt(norm)


def _batch_best(index: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Each query's best k of an index shard: query_id, chunk_id, score, as `cosine` and Spark's order have it
    (components are added in their order; NaN is the largest, null the least; ties by chunk_id). Where rows have a `cell`, a query
    meets those of its `cells` only, and of them, if it has a `floor`, those that can score as much."""
    width = max([0, *(pc.max(pc.list_value_length(t[c])).as_py() or 0 for t, c in ((index, "embedding"), (asked, "vector")))])
    index = index.sort_by("chunk_id")
    rows, sizes, norms = _vectors(index["embedding"], width)
    queries, query_sizes, query_norms = _vectors(asked["vector"], width)
    floors, code, of_cells = np.full(len(queries), -np.inf), None, None
    if "cell" in index.column_names:
        kinds, code = np.unique(index["cell"].to_numpy(), return_inverse=True)
        floor = asked["floor"].to_numpy().astype(float)  # NaN for none
        floors = np.where(np.isnan(floor), -np.inf, floor)
        of_cells = asked["cells"].combine_chunks()
    at, of, scores, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
    # rows and queries whose components are plain numbers of one length are compared by a product of matrices first, which tells
    # those that can be among the best; only they are added up in order
    whole = (sizes == width) & np.isfinite(norms) & (norms >= 1e-6) & (norms < 1e150)
    plain, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
    units = rows[plain] / norms[plain, None]
    for a in range(0, len(queries), STEP_QUERIES):
        q, q_sizes, q_norms = queries[a : a + STEP_QUERIES], query_sizes[a : a + STEP_QUERIES], query_norms[a : a + STEP_QUERIES]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            rough = (q / q_norms[:, None]) @ units.T
        for i in range(len(q)):
            there = None if code is None else np.isin(kinds, of_cells[a + i].values.to_numpy())[code]
            able = None if there is None else np.flatnonzero(there)
            if q_sizes[i] == width and 1e-6 <= q_norms[i] < 1e150 and (len(plain) > k or there is not None):
                hits = np.flatnonzero(rough[i] >= floors[a + i] - ROUGH)
                hits = hits if there is None else hits[there[plain[hits]]]
                if len(hits) > k:
                    near = rough[i, hits]
                    hits = hits[near >= np.partition(near, len(hits) - k)[len(hits) - k] - ROUGH]
                able = np.sort(np.concatenate((plain[hits], rest if there is None else rest[there[rest]])))
            if able is not None and not len(able):
                continue
            these, own, own_norms = (rows, sizes, norms) if able is None else (rows[able], sizes[able], norms[able])
            score = np.zeros(len(these))
            for d in range(width):
                score += q[i, d] * these[:, d]
            with np.errstate(invalid="ignore", divide="ignore"):
                score /= q_norms[i] * own_norms
            short = ((q_norms[i] < 1e-6) & (q_sizes[i] >= 0)) | ((own_norms < 1e-6) & (own >= 0))
            score[short] = 0.0
            ok = short | (q_sizes[i] == own) & (own >= 0)
            odd = np.isnan(score)
            best = np.lexsort((np.where(odd | ~ok, 0, -score), np.where(ok, ~odd, 2)))[:k]
            at.append(best if able is None else able[best])
            of.append(np.full(len(best), a + i))
            scores.append(score[best])
            known.append(ok[best])
    at, of, scores, known = (np.concatenate(x) for x in (at, of, scores, known))
    return pa.table({"query_id": asked["query_id"].take(pa.array(of)), "chunk_id": index["chunk_id"].take(pa.array(at)), "score": pa.array(scores, pa.float64(), mask=~known)})


def search_dense_batch(chunks: DataFrame, vectors: DataFrame, files: DataFrame, queries: DataFrame, scopes: Sequence[str] | None, top_k: int | None = DEFAULT_TOP_K) -> DataFrame:
    """Any number of query vectors (query_id, vector): query_id, chunk_id, score, rank.

    Chunks are dealt to index shards by a hash, queries to lots; each shard meets each lot in one task of
    bounded size, and only a query's best k of a shard are shuffled."""
    k = effective_top_k(top_k)
    joined = candidates(chunks, files, scopes).select("chunk_id").join(vectors.select("chunk_id", "embedding"), "chunk_id")
    shards, lots = (max(1, -(-df.count() // most)) for df, most in ((joined, SHARD_ROWS), (queries, LOT_ROWS)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    index = joined.select("chunk_id", "embedding", dealt(shards, "chunk_id").alias("shard"), spread(lots).alias("lot"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").select("*", dealt(lots, F.lit(7), "query_id").alias("lot"), spread(shards).alias("shard"))
    schema = StructType([StructField("query_id", LongType()), StructField("chunk_id", joined.schema["chunk_id"].dataType), StructField("score", DoubleType())])
    none = to_arrow_schema(schema).empty_table()

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        return _batch_best(a, b, k) if len(a) and len(b) else none

    best = index.groupBy("shard", "lot").cogroup(asked.groupBy("shard", "lot")).applyInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def search_cells_batch(index: Cells, chunks: DataFrame, files: DataFrame, queries: DataFrame, scopes: Sequence[str] | None, top_k: int | None = DEFAULT_TOP_K, *, exact: bool = True, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`search_dense_batch` by a stored index: with `exact` the same rows, else what each query's nearest cells have."""
    found = top_of_many(index, queries, candidates(chunks, files, scopes).select("chunk_id"), effective_top_k(top_k), _batch_best, exact=exact, scratch=scratch)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def neighbours(chunks: DataFrame, files: DataFrame, anchors: DataFrame, scopes: Sequence[str] | None, window: int = 2) -> DataFrame:
    """For each anchor chunk_id, the chunks of its file at most `window` places away; both ends in scope."""
    seen = chunks.join(in_scope(files, scopes).select("file_id", "file_name"), "file_id")
    around = anchors.select("chunk_id").distinct().join(seen.select("chunk_id", "file_id", "chunk_index"), "chunk_id").select(F.col("chunk_id").alias("anchor_id"), "file_id", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    return around.join(seen, ["file_id", "chunk_index"]).select("anchor_id", "file_id", "file_name", "chunk_id", "chunk_index", "chunk_text")


def on_page(chunks: DataFrame, files: DataFrame, file_id: int, page: int | None, scopes: Sequence[str] | None, sheet: str | None = None) -> DataFrame:
    where = F.col("file_id") == file_id
    if page is not None:
        where &= F.col("page_number") == page
    if sheet is not None:
        where &= F.col("sheet_name") == sheet
    return candidates(chunks, files, scopes, where).select("file_id", "chunk_id", "chunk_index", "chunk_text").orderBy("chunk_index")


def texts_in_order(chunks: DataFrame, files: DataFrame, ids: DataFrame, scopes: Sequence[str] | None) -> DataFrame:
    """ids: pos, chunk_id. Their texts in that order: duplicates stay, unknown ids and other scopes' drop out."""
    return ids.join(candidates(chunks, files, scopes).select("chunk_id", "chunk_text"), "chunk_id").select("pos", "chunk_id", "chunk_text").orderBy("pos")


def rerank(texts: DataFrame, scorer: Callable[[Column], Column] | None, top_k: int | None = None) -> DataFrame:
    """By descending score, ties in the order given; without a scorer the order given, with score 0."""
    if scorer is None:
        scored = texts.withColumn("score", F.lit(0.0)).orderBy("pos")
    else:
        scored = texts.withColumn("score", scorer(F.col("chunk_text"))).orderBy(F.desc("score"), "pos")
    return scored if top_k is None else scored.limit(top_k)


def rerank_pool(top_k: int) -> int:
    return max(top_k, 20)


def scores_or_none(backend: Callable[[str, list[str]], list[float]], query: str, texts: list[str], retries: int = 1) -> list[float] | None:
    """A rerank service's scores; None, so that the given order is kept, if it can't be reached or stays too
    slow. Any other error is raised, and so is an answer that doesn't score every text."""
    for _ in range(retries + 1):
        try:
            scores = backend(query, texts)
        except (ConnectionError, TimeoutError):
            continue
        if len(scores) != len(texts):
            raise ValueError(f"{len(scores)} scores for {len(texts)} texts")
        return scores
    return None
