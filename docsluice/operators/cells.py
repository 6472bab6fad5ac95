"""A stored vector index: clustered cells in Parquet, each row with its distance to the cell's centre.

On unit vectors cosine is 1 - d*d/2 for the distance d, so the triangle inequality bounds it: a row at distance r from its
centre is at least |r - d(query, centre)| away from the query. The exact search reads the nearest cells first, and then only
those cells, and in them only those rows, that can still hold one of the k best; the quick search stops after the first.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from docsluice.functions.vectors import cosine, norm

#: Rows that the centres are fitted on (at most, for each cell), cells at most, rows of a part of a cell.
FIT_ROWS, MOST_CELLS, PART_ROWS = 64, 4096, 20_000
#: Cells that an exact search reads first. The quick search's number is measured when the index is written: so many
#: that `RECALL` of the `TRIED_BEST` nearest rows of at most `TRIED` sampled rows are in them.
PROBES, RECALL, TRIED, TRIED_BEST = 4, 0.95, 128, 10
#: Distances of rows to centres that a task works out in one step, and rows of (query, bin) that it hands on at once.
STEP_DISTANCES, STEP_ROUTES = 1 << 20, 4096
#: Rows of a bin of cells at least (if there are as many), and queries of a lot, in searches of many queries.
LEAST_BIN, LOT_QUERIES = 2000, 2000
#: Distances are sums of rounded numbers.
SLACK = 1e-5
#: The cell of rows without a direction (near 0, null or non-finite numbers, another length): read by every search.
ODD = -1


class Cells(NamedTuple):
    rows: DataFrame
    centres: DataFrame
    dims: int
    probes: int


def write_cells(vectors: DataFrame, path: str, *, cells: int | None = None, fit_rows: int = FIT_ROWS, recall: float = RECALL, seed: int = 7) -> Cells:
    """Index vectors (chunk_id, embedding) below `path`: every row, in `cells` cells (the root of their number).

    The centres are fitted by k-means to `fit_rows` rows a cell, drawn by a hash of the id: a bounded sample, with as many cells as
    `MOST_CELLS`. Each row goes to its nearest centre. A cell of more rows than others (a third of all may be copies of one) is spread over
    parts by a hash of the id, so no task writes all of it. Rows lie by their distance to the centre, so that bounds on it skip
    row groups. How many cells the quick search needs for `recall` is measured against all rows."""
    spark = vectors.sparkSession
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding", doubles.alias("v"))
    told = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").where("dims > 0").first()
    dims, n = (told["dims"], told["n"]) if told else (0, 0)
    plain = (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e18))
    rows = rows.withColumn("length", F.when(plain, norm(F.col("v"))))
    rows = rows.select("chunk_id", "embedding", F.when(F.col("length") >= 1e-6, F.transform("v", lambda x: x / F.col("length"))).alias("u"))
    cells = max(1, min(MOST_CELLS, round(n**0.5) if cells is None else cells))
    fitted = rows.where("u IS NOT NULL AND chunk_id IS NOT NULL")
    if n > cells * fit_rows:
        fitted = fitted.where(F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(n)) < cells * fit_rows)
    points = fitted.select(array_to_vector("u").alias("features"))
    centres: list = []
    if not points.isEmpty():
        centres = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=8, initSteps=2).fit(points).clusterCenters()] if cells > 1 else [[0.0] * dims]
    middle = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")

    def nearest(batches):
        at = np.array(centres).reshape(len(centres), -1)
        for batch in batches:
            u = batch.column("u")
            cell, far = np.full(len(u), ODD, np.int32), np.full(len(u), np.nan)
            ok = u.is_valid().to_numpy(zero_copy_only=False)
            if ok.any():
                x = u.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(ok.sum()), -1)
                best = _nearest(x, at)
                cell[ok], far[ok] = best, np.sqrt(((x - at[best]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("embedding"), u, pa.array(cell), pa.array(far, mask=~ok)], ["chunk_id", "embedding", "u", "cell", "far"])

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = rows.mapInArrow(nearest, f"chunk_id long, embedding {kind}, u array<double>, cell int, far double")
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n // (cells * PART_ROWS))) * 8)).cast("int")
    files = max(8, min(2 * cells, -(-n // PART_ROWS)))
    placed = placed.withColumn("part", part).repartition(files, "cell", "part").sortWithinPartitions("cell", "far")
    placed.write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n"))
    stored.join(middle, "cell", "left").coalesce(1).write.parquet(f"{path}/centres")  # a row for each cell
    tried = fitted.orderBy(F.xxhash64(F.lit(seed + 1), "chunk_id")).limit(TRIED).select("u").collect()
    probes = _probes_for(recall, spark.read.parquet(f"{path}/rows"), np.array([r["u"] for r in tried]), np.array(centres))
    spark.createDataFrame([(json.dumps({"dims": dims, "kind": kind, "probes": probes}),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return open_cells(spark, path)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Each row's nearest centre, for as many rows at once as `STEP_DISTANCES` allows."""
    sizes, step = (centres * centres).sum(1), max(1, STEP_DISTANCES // len(centres))
    return np.concatenate([((y * y).sum(1)[:, None] - 2 * y @ centres.T + sizes).argmin(1) for y in (x[a : a + step] for a in range(0, len(x), step))])


def _probes_for(recall: float, rows: DataFrame, tried: np.ndarray, centres: np.ndarray) -> int:
    """The least number of nearest cells that hold this share of the nearest rows of the tried ones, which a scan of
    all rows finds; each task keeps the best few of each."""
    if not len(tried):
        return 1

    def best(batches):
        kept = [(np.empty(0), np.empty(0, np.int64))] * len(tried)
        for batch in batches:
            u = batch.column("u").drop_null()
            x = u.flatten().to_numpy(zero_copy_only=False).reshape(len(u), -1)
            cell = batch.column("cell").filter(batch.column("u").is_valid()).to_numpy()
            if len(x):
                for i, dots in enumerate(tried @ x.T):
                    s, c = np.concatenate([kept[i][0], dots]), np.concatenate([kept[i][1], cell])
                    top = np.argsort(-s, kind="stable")[: TRIED_BEST + 1]
                    kept[i] = s[top], c[top]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(tried)), [len(s) for s, _ in kept])), pa.array(np.concatenate([s for s, _ in kept])), pa.array(np.concatenate([c for _, c in kept]).astype(np.int32))], ["i", "s", "cell"])

    found = rows.select("u", "cell").mapInArrow(best, "i long, s double, cell int")
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s")))
    found = found.withColumn("place", place).where(F.col("place").between(2, TRIED_BEST + 1)).select("i", "cell").collect()  # the first is the row itself
    order = [np.argsort(((centres - t) ** 2).sum(1), kind="stable") for t in tried]
    needed = np.sort([int(np.flatnonzero(order[r["i"]] == r["cell"])[0]) + 1 for r in found])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def open_cells(spark: SparkSession, path: str) -> Cells:
    told = json.loads(spark.read.text(f"{path}/meta").first()[0])
    rows = spark.read.schema(f"chunk_id long, embedding {told['kind']}, u array<double>, far double, part int, cell int").parquet(f"{path}/rows")
    return Cells(rows, spark.read.schema("cell int, low double, high double, n long, centre array<double>").parquet(f"{path}/centres"), told["dims"], told["probes"])


class _Centres(NamedTuple):
    """All cells on the driver: at most MOST_CELLS rows."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    odd: bool
    sizes: dict[int, int]


def _centres(index: Cells) -> _Centres:
    rows = index.centres.collect()
    known = [r for r in rows if r["centre"] is not None]
    column = lambda c: np.array([r[c] for r in known], float)
    return _Centres(np.array([r["cell"] for r in known], np.int64), column("low"), column("high"), column("centre").reshape(len(known), -1), len(known) < len(rows), {r["cell"]: r["n"] for r in rows})


def bins_of(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """Each cell's first bin and number of bins: small cells share a bin of at most so many rows, a larger one has several."""
    out, bins, held = {}, 0, 0
    for cell, n in sorted(sizes.items()):
        if n > most:
            bins += held > 0
            out[cell], held = (bins, -(-n // most)), 0
            bins += out[cell][1]
        else:
            if held + n > most:
                bins, held = bins + 1, 0
            out[cell], held = (bins, 1), held + n
    return out


def _reach(score: float | None) -> float:
    """The distance of unit vectors with this cosine; without end, if it is none."""
    return np.inf if score is None or np.isnan(score) else max(0.0, 2 - 2 * score) ** 0.5 + SLACK


def able_cells(at: _Centres, d: np.ndarray, reach: float) -> np.ndarray:
    """Which cells can have a row within `reach` of a query at the distances d from their centres."""
    return np.flatnonzero((d - at.high <= reach) & (at.low - d <= reach))


def top_by_cells(index: Cells, query: Sequence[float], seen: Callable[[DataFrame], DataFrame], k: int, *, exact: bool = True, probes: int | None = None) -> list[tuple[int, float]]:
    """(chunk_id, cosine) of the k nearest rows that may be seen; ties by chunk_id. `exact` as a scan of all rows; else
    of the `probes` nearest cells only (the index's own number). A query without a direction, or of another length, needs all rows."""
    q = np.array([np.nan if x is None else x for x in query], float)
    asked = F.array(*(F.lit(float(x)) for x in query))
    at, probes = _centres(index), probes or (PROBES if exact else index.probes)

    def best(rows: DataFrame) -> list[tuple[int, float]]:
        scored = rows.withColumn("score", cosine(F.col("embedding"), asked))
        return [tuple(r) for r in seen(scored.drop("embedding", "u")).select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(k).collect()]

    size = float(np.sqrt((q * q).sum())) if len(q) else 0.0
    if len(q) != index.dims or not np.isfinite(size) or size < 1e-6 or not len(at.cell):
        return best(index.rows)
    d = np.sqrt(((at.centre - q / size) ** 2).sum(1))
    near = np.argsort(d, kind="stable")[:probes]
    odd = [ODD] * at.odd
    first = best(index.rows.where(F.col("cell").isin([int(c) for c in at.cell[near]] + odd)))
    if not exact:
        return first
    reach = _reach(first[-1][1]) if len(first) == k else np.inf
    rings = {int(at.cell[i]): (float(d[i]) - reach, float(d[i]) + reach) for i in able_cells(at, d, reach)}
    chosen = index.rows.where(F.col("cell").isin([*rings, *odd]))
    if rings and np.isfinite(reach):  # in each cell a ring around its centre; the widest of all is a filter of the scan
        bound = lambda j: F.element_at(F.create_map(*(F.lit(x) for c, r in rings.items() for x in (c, r[j]))), F.col("cell"))
        within = F.col("far").between(min(r[0] for r in rings.values()), max(r[1] for r in rings.values())) & F.col("far").between(bound(0), bound(1))
        chosen = chosen.where((F.col("cell") == ODD) | within)
    return best(chosen)


def top_of_many(index: Cells, queries: DataFrame, allowed: DataFrame | None, k: int, score: Callable[[pa.Table, pa.Table, int], pa.Table], *, exact: bool = True, probes: int | None = None, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any number of queries (query_id, vector): query_id, chunk_id, score, the k best of each.

    Cells are put together in bins of bounded size. Every query is sent to the bins of its nearest cells, once to each, with those
    cells' numbers, and meets their rows there in tasks of bounded size; rows are sent once for each lot of a bin's queries, not for
    all of them. `exact`: then to the cells that its k-th score leaves able, in one more round, where only rows that can reach that
    score are added up. allowed: chunk_ids that may be seen (all, if None). score: the best k of a table of rows (with their cell)
    for each of a table of queries (with the cells they ask for, and a floor). scratch: writes a table and reads it again."""
    at, dims, probes = _centres(index), index.dims, probes or (PROBES if exact else index.probes)
    spark = index.rows.sparkSession
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    rows = index.rows if allowed is None else index.rows.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    every = [int(c) for c in at.cell] + [ODD] * at.odd
    bins = bins_of(at.sizes, min(PART_ROWS, max(LEAST_BIN, -(-sum(at.sizes.values()) // spark.sparkContext.defaultParallelism))))
    places = spark.createDataFrame([(c, *b) for c, b in bins.items()], "cell int, first int, bins int")
    lookup = np.zeros((max(bins, default=0) + 2, 2), np.int64)  # of cell c in row c + 1
    for c, b in bins.items():
        lookup[c + 1] = b

    def routed(asked: DataFrame, again: bool) -> DataFrame:
        """query_id, vector, floor, bin, cells: where each query goes, at first and (with `floor`, its k-th score) again."""

        def route(batches):
            for batch in batches:
                floors = batch.column("floor").to_pylist() if again else [None] * len(batch)
                sent, to_bins, to_cells = [], [], []

                def handed():
                    take = pa.array(sent, pa.int64())  # a vector is repeated for each of its bins, so not for all at once
                    floor = pa.array([floors[i] for i in sent], pa.float64())
                    return pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("vector").take(take), floor, pa.array(to_bins, pa.int32()), pa.array(to_cells, pa.list_(pa.int32()))], ["query_id", "vector", "floor", "bin", "cells"])

                for i, (v, floor) in enumerate(zip(batch.column("vector"), floors, strict=True)):
                    q = np.array([np.nan if x is None else x for x in v.as_py() or []], float)
                    size = float(np.sqrt((q * q).sum())) if len(q) else 0.0
                    if len(q) != dims or not np.isfinite(size) or size < 1e-6 or not len(at.cell):
                        to = [] if again else every
                    else:
                        d = np.sqrt(((at.centre - q / size) ** 2).sum(1))
                        near = np.argsort(d, kind="stable")[:probes]
                        to = at.cell[np.setdiff1d(able_cells(at, d, _reach(floor)), near)] if again else [*at.cell[near], *[ODD] * at.odd]
                    to = np.sort(np.asarray(to, np.int64))  # bins ascend with their cells
                    first, n = lookup[to + 1].T
                    starts = np.flatnonzero(np.append(True, first[1:] != first[:-1])[: len(to)])
                    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(to)]):
                        for bin in range(first[a], first[a] + n[a]):
                            sent.append(i)
                            to_bins.append(bin)
                            to_cells.append(to[a:b])
                            if len(sent) >= STEP_ROUTES:
                                yield handed()
                                sent.clear(), to_bins.clear(), to_cells.clear()
                if sent:
                    yield handed()

        return asked.mapInArrow(route, "query_id long, vector array<double>, floor double, bin int, cells array<int>")

    schema = StructType([StructField("query_id", LongType()), StructField("chunk_id", LongType()), StructField("score", DoubleType())])
    none = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())]).empty_table()

    def met(sent: DataFrame) -> DataFrame:
        """Each query's best k of each bin it was sent to."""
        sent = scratch(sent)
        lots = sent.groupBy("bin").agg(F.ceil(F.count("*") / LOT_QUERIES).cast("int").alias("lots"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        of_rows = rows.select("chunk_id", "embedding", "cell").join(F.broadcast(places), "cell")
        of_rows = of_rows.select("chunk_id", "embedding", "cell", (F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("bins"))).cast("int").alias("bin"))
        of_rows = of_rows.join(F.broadcast(lots), "bin").select("chunk_id", "embedding", "cell", "bin", spread(F.col("lots")).alias("lot"))
        of_queries = sent.join(F.broadcast(lots), "bin").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int")).select("query_id", "vector", "floor", "cells", "bin", "lot")
        of_queries = of_queries.toDF(*of_queries.columns)  # names of their own: they meet rows that they were counted with
        return of_rows.groupBy("bin", "lot").cogroup(of_queries.groupBy("bin", "lot")).applyInArrow(lambda a, b: score(a, b, k) if len(a) and len(b) else none, schema)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    first = scratch(best(met(routed(queries, False))))
    if not exact:
        return first
    floors = first.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).alias("floor"))
    again = met(routed(queries.join(floors, "query_id", "left").select("query_id", "vector", "floor"), True))
    return best(first.union(again))
