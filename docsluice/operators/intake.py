"""Intake: new files against known ones, and changes of state of files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.schema import OUTCOMES

MAX_FILE_MB = 100
RETRY_LIMIT = 3
STUCK_MINUTES = 30
#: Arrival numbers that one window counts over.
STRETCH = 100_000


def stored_path(root: Column, checksum: Column, name: Column) -> Column:
    """<root>/raw/<first two of checksum>/<checksum>/<name>, characters that are unsafe in names as _."""
    return F.concat_ws("/", root, F.lit("raw"), F.substring(checksum, 1, 2), checksum, F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"))


def running_count(df: DataFrame, key: str, order: str, counted: str, out: str, stretch: int = STRETCH) -> DataFrame:
    """Adds to the rows where `counted` holds how many of the key there are up to them (null elsewhere), by ascending `order`, a whole number
    that no two rows of a key share.

    Rows are counted within stretches of `stretch` numbers, which bounds a window, and the counts of a key's stretches are added up
    over one row a stretch: no task has to take all rows of a key."""
    part = Window.partitionBy(key, "__stretch")
    mine = df.where(counted).withColumn("__stretch", F.floor(F.col(order) / stretch))
    sums = mine.groupBy(key, "__stretch").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(key).alias("__key"), F.col("__stretch").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    mine = mine.select(key, "__stretch", order, F.row_number().over(part.orderBy(order)).alias("__own"))
    counts = mine.join(sums, mine[key].eqNullSafe(F.col("__key")) & (F.col("__stretch") == F.col("__of"))).select(F.col(key).alias("__key"), F.col(order).alias("__at"), (F.col("__before") + F.col("__own")).alias(out))
    return df.join(counts, df[key].eqNullSafe(F.col("__key")) & (df[order] == F.col("__at")) & F.col(counted), "left").drop("__key", "__at")


def intake(arrivals: DataFrame, known: DataFrame, max_mb: int = MAX_FILE_MB) -> DataFrame:
    """arrivals: arrival_no, file_name, file_type (null: unsupported), checksum, file_size. known: file_name,
    checksum, doc_version. Adds outcome, doc_version, fail_reason.

    A content that is known, or came earlier in the batch, is SKIPPED whatever its name; an unsupported type
    is REJECTED; a new content under a name that is known is VERSIONED with the next version; one too large
    is FAILED (it has a version too). arrival_no is unique. The first of a content is a grouped minimum, so a
    content that very many files share is added up before it is shuffled; versions under one name are counted in stretches of
    `STRETCH` arrival numbers, so a name that very many files share is many tasks."""
    seen = known.select("checksum").distinct().withColumn("__seen", F.lit(True))
    last = known.groupBy("file_name").agg(F.max("doc_version").alias("__last"))
    ok = F.col("file_type").isNotNull()
    first = arrivals.where(ok).groupBy("checksum").agg(F.min("arrival_no").alias("__first"))
    a = arrivals.join(seen, "checksum", "left").join(first, "checksum", "left").join(last, "file_name", "left")
    fresh = ok & F.col("__seen").isNull() & (F.col("arrival_no") == F.col("__first"))
    large = F.col("file_size") > max_mb * 1024 * 1024
    a = running_count(a.withColumn("__fresh", fresh), "file_name", "arrival_no", "__fresh", "__nth")
    a = a.withColumn("doc_version", F.when(F.col("__fresh"), (F.coalesce("__last", F.lit(0)) + F.col("__nth")).cast("int"))).drop("__nth")
    outcome = F.when(~ok, "REJECTED").when(~F.col("__fresh"), "SKIPPED").when(large, "FAILED").when(F.col("doc_version") > 1, "VERSIONED").otherwise("CREATED")
    return a.withColumn("outcome", outcome).withColumn("fail_reason", F.when(F.col("outcome") == "FAILED", f"larger than {max_mb} MB")).drop("__seen", "__last", "__first", "__fresh")


def outcome_counts(taken: DataFrame) -> DataFrame:
    """All outcomes, those that didn't occur as 0."""
    every = taken.sparkSession.createDataFrame([(x,) for x in OUTCOMES], "outcome string")
    return every.join(taken.groupBy("outcome").agg(F.count("*").alias("files")), "outcome", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def retryable(files: DataFrame, limit: int = RETRY_LIMIT) -> DataFrame:
    return files.where((F.col("status") == "FAILED") & (F.col("retry_count") < limit))


def stuck(files: DataFrame, now: datetime, minutes: int = STUCK_MINUTES) -> DataFrame:
    return files.where((F.col("status") == "PROCESSING") & (F.col("updated_at") < F.lit(now) - F.make_interval(mins=F.lit(minutes))))


def requeued(files: DataFrame) -> DataFrame:
    return files.withColumn("status", F.lit("PENDING")).withColumn("retry_count", F.col("retry_count") + 1).withColumn("fail_reason", F.lit(None).cast("string"))


def reprocess_from(metrics: DataFrame) -> DataFrame:
    """file_id and start: `parse` if the latest intake had copied the file, else `intake`."""
    copied = F.max_by(F.coalesce(F.get_json_object("detail", "$.copied") == "true", F.lit(False)), "metric_id")
    return metrics.where("step = 'intake'").groupBy("file_id").agg(F.when(copied, "parse").otherwise("intake").alias("start"))


def pending(files: DataFrame, limit: int | None = None) -> DataFrame:
    out = files.where("status = 'PENDING'").orderBy("file_id")
    return out if limit is None else out.limit(limit)


def updated(files: DataFrame, changes: DataFrame, key: str = "file_id") -> DataFrame:
    """files with the non-null values of `changes` (key and any of the columns)."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in names))
    return files.join(new, key, "left").select(*(F.coalesce(F.col(f"__{c}").cast(files.schema[c].dataType), F.col(c)).alias(c) if c in names else F.col(c) for c in files.columns))


def copy_raw(files: DataFrame, root: str) -> None:
    """Write each file's content (checksum, file_name, content) to its place below `root`, a path or URI. What
    is there already is left: the place is named by the content."""
    placed = files.select(stored_path(F.lit(""), F.col("checksum"), F.col("file_name")).alias("place"), "content")

    def write(rows) -> None:
        import uuid

        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for row in rows:
            path = f"{base}{row['place']}"
            if fs.get_file_info(path).type == pafs.FileType.NotFound:
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"  # a task that is lost half-way leaves no half file in place
                with fs.open_output_stream(part) as f:
                    f.write(bytes(row["content"]))
                fs.move(part, path)

    placed.foreachPartition(write)
