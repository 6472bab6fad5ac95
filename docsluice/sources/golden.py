"""Golden question sets: JSON lines in, checked, replaced as a whole."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsluice.functions.text import normalize
from docsluice.operators.evaluate import evidence_mismatches, golden_rules
from docsluice.schema import GOLDEN


class GoldenError(ValueError):
    pass


#: Faults that an error names; `golden_faults` has all.
NAMED = 20


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of all lines of the text files at `path`, without reading a file in one task.

    A split's lines are counted in their task; the counts of a file's splits, added up in order, are where each begins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(F.col("file").alias("its_file"), F.col("split").alias("its_split"), (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    told = lines.join(splits, (F.col("file") == F.col("its_file")) & (F.col("split") == F.col("its_split")))
    return told.select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.select("file", "line", "value", F.from_json("value", f"{GOLDEN}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))


def golden_faults(spark: SparkSession, path: str) -> DataFrame:
    """file, line and problem of everything that is wrong with the records of JSON-lines files; blank lines are passed over.

    A line that is no record, a field that records (or their evidence) don't have, a rule that is broken, an id or a question that an
    earlier line has (files in the order of their names): each occurrence after the first, by grouped minima."""
    parsed = _parsed(spark, path)
    fields = parsed.schema["r"].dataType
    known, of_evidence = (F.array(*(F.lit(n) for n in kind.names if n != "_bad")) for kind in (fields, fields["gold_evidence"].dataType.elementType))
    record = F.col("r._bad").isNull() & F.col("r.id").isNotNull() & F.col("r.question").isNotNull()
    evidence = F.from_json(F.get_json_object("value", "$.gold_evidence"), "array<map<string,string>>")
    parts = F.array_distinct(F.flatten(F.transform(F.coalesce(evidence, F.array().cast("array<map<string,string>>")), F.map_keys)))
    strange = F.concat(F.array_except(F.json_object_keys("value"), known), F.array_except(parts, of_evidence))
    bad = parsed.where(~F.coalesce(record, F.lit(False))).select("file", "line", F.lit("no record").alias("problem"))
    good = parsed.where(record)
    fields = good.select("file", "line", F.explode(strange).alias("f")).select("file", "line", F.concat(F.lit("unknown field "), F.col("f")).alias("problem"))
    rules = golden_rules(good.select("file", "line", "r.*")).select("file", "line", "problem")
    place = F.struct("file", "line")

    def again(key: Column, what: str) -> DataFrame:
        keyed = good.select("file", "line", key.alias("key"))
        first = keyed.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        late = keyed.join(first, "key").where(place > F.col("first"))
        return late.select("file", "line", F.concat(F.lit(f"{what} of line "), F.col("first.line").cast("string")).alias("problem"))

    return bad.union(fields).union(rules).union(again(F.col("r.id"), "id")).union(again(normalize(F.col("r.question")), "question"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines files. What `golden_faults` finds is an error that names the first lines, and how many there are."""
    faults = golden_faults(spark, path)
    if first := faults.orderBy("file", "line", "problem").limit(NAMED).collect():
        told = "; ".join(f"{f['file'].rsplit('/', 1)[-1]}:{f['line']}: {f['problem']}" for f in first)
        raise GoldenError(told + (f" (and more: {faults.count()} in all)" if len(first) == NAMED else ""))
    return _parsed(spark, path).select("r.*").drop("_bad")


def set_hash(golden: DataFrame) -> str:
    """Of the records' canonical JSON in the order of their ids. Golden sets are a few hundred questions."""
    rows = [r.asDict(recursive=True) for r in golden.orderBy("id").collect()]
    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def load_golden(spark: SparkSession, golden: DataFrame, version: str, root: str, files: DataFrame | None = None, chunks: DataFrame | None = None) -> str:
    """Write a version below `root`: `unchanged` if it is there with the same hash, else `replaced` or `created`.

    With the corpus (files and chunks), evidence that is not in it is an error that names the first records, and
    nothing is written."""
    if files is not None and chunks is not None:
        if missing := evidence_mismatches(golden, files, chunks).orderBy("id", "evidence_no").limit(20).collect():
            raise GoldenError("; ".join(f"{m['id']}: {m['reason']} ({m['file_name']})" for m in missing))
    new, found = set_hash(golden), None
    try:
        found = spark.read.parquet(f"{root}/sets").where(F.col("set_version") == version).select("payload_hash").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    if found and found[0] == new:
        return "unchanged"
    put = lambda df, name: df.withColumn("set_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_version").parquet(f"{root}/{name}")
    put(golden, "records")
    put(spark.createDataFrame([(new, golden.count())], "payload_hash string, record_count int"), "sets")
    return "replaced" if found else "created"


def golden_records(spark: SparkSession, version: str, root: str) -> DataFrame:
    """A version's records in the order of their ids."""
    return spark.read.parquet(f"{root}/records").where(F.col("set_version") == version).orderBy("id")


def tables_ready(spark: SparkSession, names: tuple[str, ...] = ("eval_golden_sets", "eval_golden_records")) -> bool:
    """Whether tables of these names are in the catalog."""
    return all(spark.catalog.tableExists(n) for n in names)
