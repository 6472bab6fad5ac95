"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs on one machine (tests, a laptop) a temporary folder stands in for
    it; on a cluster that is an error, since executors could not read each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            at = set_already.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            at = f"file://{tempfile.mkdtemp(prefix='docsluice-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at if urlparse(at).scheme else f"file://{at}"


class Scratch:
    """Files and tables of one run in the shared folder: whoever holds it deletes them by `close`.

    An operator's own Scratch is closed when it returns. What its result reads is in the caller's, where one
    was given; else those files stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._tables = spark, [], []

    def path(self, name: str) -> str:
        self._paths.append(f"{shared_dir(self.spark).rstrip('/')}/docsluice/{name}-{uuid.uuid4().hex}")
        return self._paths[-1]

    def saved(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Written to the shared folder and read again: cuts lineage, and fixes what later steps read."""
        path, writer = self.path(name), df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """Written to a table in buckets of a column: joins and groups by it need no exchange then."""
        self._tables.append(f"docsluice_{name}_{uuid.uuid4().hex}")
        df.write.bucketBy(buckets_of(self.spark), column).option("path", self.path(name)).option("compression", "zstd").saveAsTable(self._tables[-1])
        self._rid()
        return self.spark.table(self._tables[-1])

    def _rid(self) -> None:
        """Let Spark's cleaner delete the shuffle files of what has been written: it does so once the driver has collected
        the plans, which by itself it may not do for many rounds."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        while self._paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._paths.pop())
            path.getFileSystem(conf).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def buckets_of(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """In a Python worker: the model of this key, made once and kept for the tasks that follow. Workers serve
    one stage after the other, so a worker keeps one model only: another key's is let go first."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


_STAGE: list[int] = []


def keep_freed(most: int = 64 << 20) -> None:
    """In a Python worker: for the rest of a stage, arrays of up to `most` bytes come from memory that the worker has freed
    before, and not each time from the system, which has to clear it first. What the stage before has left is given back."""
    stage = TaskContext.get().stageId()
    if _STAGE == [stage]:
        return
    _STAGE[:] = [stage]
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, most)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 2 * most)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let_go() -> None:
    """Give back the memory of a model that an earlier stage left in this worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def named(column: str) -> Column:
    """A column by its name as it stands, with dots, spaces or quotes in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def apart(name: str, *taken: str) -> str:
    """An id column's name in a result: its own, with `_id` behind it where the result has another column of that name."""
    while name in taken:
        name += "_id"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, a null as none."""
    return df.agg(F.sum(F.octet_length(named(column)))).first()[0] or 0


def pieces(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))


def train_flag(column, modulus: int, held: int):
    """True for documents whose crc32(id as text) has another remainder than `held`."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus != held, F.lit(True))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch, a null as the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


class TwoGenerationCache:
    """A dict bounded to about twice `limit` entries: when the young generation is full it becomes
    the old one, and entries asked for again move back. Frequent words so stay; memory is bounded."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def unknown(self, keys: list) -> list:
        """Make room, bring known keys into the young generation; return the distinct unknown ones."""
        young, old = self.young, self.old
        new = {k for k in keys if k not in young}
        if len(young) + len(new) > self.limit and young:
            self.old, self.young = young, {}
            young, old = self.young, self.old
            new = set(keys)
        missing = []
        for k in new:
            v = old.get(k)
            if v is None:
                missing.append(k)
            else:
                young[k] = v
        return missing
