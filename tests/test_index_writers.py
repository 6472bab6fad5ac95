"""How the blocks of a stored index are dealt to the tasks that write them."""

from pyspark.sql import functions as F

from docsluice.operators import postings


def test_no_task_writes_the_blocks_of_several_buckets_or_of_a_frequent_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "HEAVY", 64, raising=False)
    text = F.concat_ws(" ", F.lit("the the the"), *(F.concat(F.lit(f"w{j}x"), (F.col("id") * 7 + j * 13) % 97) for j in range(12)))
    chunks = spark.range(0, 4000, 1, 8).select(F.col("id").alias("chunk_id"), F.col("id").alias("file_id"), text.alias("chunk_text_norm"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    index = postings.write_postings(spark.read.parquet(str(tmp_path / "chunks")), str(tmp_path / "index"), slice_chunks=64)
    # a file is one task's blocks of one bucket; its number is in its name
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)
    blocks = index.blocks.select("term", "n", "occurrences", "bucket", part.alias("task"))
    assert blocks.where("term = 'the'").select("task").distinct().count() >= 12  # one, when a bucket was one task's
    rare = blocks.where("term <> 'the' AND bucket >= 0")
    assert rare.groupBy("task").agg(F.count_distinct("bucket").alias("n")).agg(F.max("n")).first()[0] == 1  # up to four by a hash of buckets
    told = {r["term"]: (r["chunks"], r["occurrences"]) for r in postings.term_counts(index).collect()}
    assert told["the"] == (4000, 12000) and sum(c for c, _ in told.values()) == 4000 * 13
