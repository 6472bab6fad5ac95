"""Sharding by a two-pass external shuffle: scatter, then Fisher-Yates within each bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from docsluice.llm.common import Scratch, pieces

SHARDS = 16
BUCKET_BYTES = 24 << 20


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n)."""
    order = list(range(n))
    rng = np.random.default_rng(seed)
    draws = (rng.random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64).tolist()
    for last, j in zip(range(n - 1, 0, -1), draws, strict=True):
        order[last], order[j] = order[j], order[last]
    return np.asarray(order, np.int64)


def shuffle_into_shards(df: DataFrame, out: str | None = None, *, text_col: str = "text", shards: int = SHARDS, seed: int = 20, bucket_bytes: int = BUCKET_BYTES, in_files: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Shuffle whole rows into `shards` Parquet folders below `out` and return the written table.

    Law `rows`: shard sizes differ by one row at most. Columns `shard` (int) and `slot` (long, gapless
    from 0 within a shard, the place in the shuffled order) are added; input columns with these names
    are replaced, all others (of any names) are written as they are.

    Pass 1 scatters rows by a seeded hash of their columns (but maps) and of their places in the input into
    buckets of about `bucket_bytes`, so no id, source, group of equal texts or of rows equal in every column
    fills a bucket; each bucket is one partition of the exchange. Places must be the same when a task is run
    again: the input is written first, unless it is read straight from files (`in_files`). Pass 2 sorts a
    bucket by that hash, permutes it by Fisher-Yates with a seed of its own and writes it; a bucket's place in
    the order is the count of the rows in the buckets before it (one count per bucket, summed by a window over
    as many rows as there are buckets, and sent to its bucket). A lost executor's bucket is drawn again the same.

    Null ids and texts are rows like others, and so are very long texts, ties and repeated rows; an empty table
    gives an empty result.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    out = out or scratch.path("shards")
    df = df.drop("shard", "slot")
    columns = df.columns
    with Scratch(spark) as tmp:
        # columns by number: names may have dots
        df = df.toDF(*(f"c{i}" for i in range(len(columns))))
        df = df if in_files else tmp.saved(df, "rows")
        size = F.coalesce(F.octet_length(f"c{columns.index(text_col)}"), F.lit(0)) + 1
        buckets = pieces(df.agg(F.sum(size)).first()[0] or 0, bucket_bytes)
        hashed = [F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
        place = F.monotonically_increasing_id()
        tagged = df.select(F.struct(*df.columns).alias("row"), F.xxhash64(F.lit(seed), place, *hashed).alias("tag"))
        tagged = tagged.select("row", "tag", F.pmod("tag", F.lit(buckets)).cast("int").alias("bucket"))
        counts = tagged.groupBy("bucket").agg(F.count("*").alias("n"))
        before, all_ = Window.orderBy("bucket"), Window.partitionBy()
        places = counts.select(F.lit(None).cast(tagged.schema["row"].dataType).alias("row"), F.lit(None).cast("long").alias("tag"), "bucket", (F.sum("n").over(before) - F.col("n")).alias("start"), F.sum("n").over(all_).alias("total"))
        schema = tagged.select("row").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).schema
        dealt = tagged.select("*", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("total")).union(places).repartitionById(buckets, F.col("bucket"))
        arrow = to_arrow_schema(dealt.schema)

        def permute(batches):
            rows = pa.Table.from_batches(batches, arrow)
            for told in rows.filter(rows["start"].is_valid()).drop_columns(["row"]).to_pylist():
                own = rows.filter(pa.compute.and_(pa.compute.equal(rows["bucket"], told["bucket"]), rows["tag"].is_valid()))
                each, more = divmod(told["total"], shards)
                tags = own["tag"].to_numpy()
                order = np.argsort(tags, kind="stable")[fisher_yates(len(tags), [seed, told["bucket"]])]
                at = told["start"] + np.arange(len(tags))
                edge = more * (each + 1)  # the first `more` shards have a row more
                shard = np.where(at < edge, at // (each + 1), more + (at - edge) // max(each, 1))
                slot = at - np.where(shard < more, shard * (each + 1), edge + (shard - more) * each)
                shuffled = pa.table({"row": own["row"].take(pa.array(order)), "shard": pa.array(shard, pa.int32()), "slot": pa.array(slot, pa.int64())})
                yield from shuffled.to_batches(max_chunksize=10_000)

        shuffled = dealt.mapInArrow(permute, schema).select(*(F.col("row")[f"c{i}"].alias(f"c{i}") for i in range(len(columns))), "shard", "slot")
        shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)
        return spark.read.schema(shuffled.schema).parquet(out).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "shard", "slot")
