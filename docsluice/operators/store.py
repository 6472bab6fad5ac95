"""Writing what is derived from files: per file all or nothing, with its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.operators.snapshots import Snapshots

DERIVED = ("chunks", "vectors", "tables", "figures", "embed_results")


def chunk_id(file_id: Column, chunk_index: Column) -> Column:
    """A number that depends on nothing else, so that reprocessing keeps ids."""
    return F.xxhash64(file_id, chunk_index)


def replace_files(spark: SparkSession, root: str, file_ids: DataFrame, new: dict[str, DataFrame], files: DataFrame) -> Snapshots:
    """Replace all rows of the given files in the derived tables below `root`, and their rows of `files`, in one version:
    who reads sees all of it or nothing. `files` may have more files than these only in the first version."""
    store = Snapshots(spark, root)
    if "files" not in store.tables():
        store = store.commit({"files": files}, files)
    states = files.join(file_ids.select("file_id").distinct(), "file_id", "left_semi")
    return store.commit({**{name: df for name, df in new.items() if name in DERIVED}, "files": states}, file_ids)


def without_files(table: DataFrame, file_ids: DataFrame) -> DataFrame:
    """A table without all rows of some files."""
    return table.join(file_ids.select("file_id"), "file_id", "left_anti")


def replace_findings(findings: DataFrame, new: DataFrame, file_ids: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """Findings with those of `codes` about the files replaced by `new`: running it again changes nothing."""
    gone = findings.where(F.col("finding").isin(*codes)).join(file_ids.select("file_id"), "file_id", "left_semi")
    return findings.join(gone.select("finding_id"), "finding_id", "left_anti").unionByName(new, allowMissingColumns=True)


def metric_rows(df: DataFrame, step: str, detail: list[str], *, ok: Column | None = None, duration_ms: Column | None = None) -> DataFrame:
    """Rows of the table of metrics: what a step measured, as JSON, whether it went well (by default it did), and how long it took."""
    null = F.lit(None).cast("int")
    return df.select("file_id", F.lit(step).alias("step"), (F.lit(True) if ok is None else ok).alias("ok"), (null if duration_ms is None else duration_ms.cast("int")).alias("duration_ms"), F.to_json(F.struct(*detail)).alias("detail"))


def upsert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the table doesn't have, one of each."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
