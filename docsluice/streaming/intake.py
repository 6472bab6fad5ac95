"""Intake as a stream over a folder: new files once, each content once.

What has been taken in is a stored table, which outlives any query; a batch is held against it, so the query itself keeps no state and
runs for ever in the same memory. `first_of_each` is for streams without a store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema: str, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def first_of_each(stream: DataFrame, text_col: str = "text", time_col: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each content. With a time column the memory of contents is bounded by a watermark."""
    keyed = stream.withColumn("checksum", F.sha2(text_col, 256))
    if time_col is None:
        return keyed.dropDuplicates(["checksum"])
    return keyed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["checksum"])


def into_store(folder: str, columns: Sequence[str], order: str, text_col: str = "text") -> Callable[[DataFrame, int], None]:
    """A sink that appends the contents which aren't in the store at `folder`, each once: `checksum` and the given columns.

    Of equal contents in a batch the first by `order` is taken, by a grouped minimum over checksums (texts aren't exchanged); those that the
    store has go by an anti join that reads its checksums only. A batch is a folder of its own: one that is done again, after a
    failure, doesn't see what it had written and replaces it. A null text is a content like others."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.sha2(text_col, 256).alias("checksum"), F.col(order).alias("__order"), F.struct(*columns).alias("__row"))
        rows = rows.groupBy("checksum").agg(F.min_by("__row", "__order").alias("__row"))
        if number:
            known = batch.sparkSession.read.schema("checksum string, batch long").parquet(folder).where(F.col("batch") < number).select(F.col("checksum").alias("__known"))
            rows = rows.join(known, F.col("checksum").eqNullSafe(F.col("__known")), "left_anti")
        rows.select("checksum", "__row.*").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work through what is there and stop; a batch that raises is done again at the next start."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
