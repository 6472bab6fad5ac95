"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.llm.bpe import bpe_round_trip
from docsluice.llm.common import documents, train_flag
from docsluice.llm.decontaminate import find_contamination
from docsluice.llm.fill_middle import middle_digests
from docsluice.llm.language_id import fit_language_filter, identify_language
from docsluice.llm.language_model import score_documents
from docsluice.llm.line_dedup import LOWER, UPPER, line_digests
from docsluice.llm.merkle import leaf_digest, merkle_manifest
from docsluice.llm.set_join import similar_groups
from docsluice.llm.sharding import shuffle_into_shards
from docsluice.llm.suffix_dedup import repeat_digests
from docsluice.llm.token_counts import count_tokens_by_line
from docsluice.llm.token_files import digest_token_files, write_token_files
from docsluice.llm.topk import top_k


#: Passages of over 50 words have so many bytes at least, but for runs of very short words; op1 tells how much of a
#: document they are beside what its contract (400 bytes) removes.
PASSAGE_BYTES = 256


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir), least=400, note=PASSAGE_BYTES)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens_by_line(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir)).drop("block", "idx")


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), train_flag(F.col("doc_id"), 7, 2))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    train = train_flag(F.col("doc_id"), 4, 2)
    model = fit_language_filter(docs, train)
    return identify_language(docs.select("doc_id", (~train).alias("held_out"), "text"), model).drop("text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_token_files(write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(documents(spark, sf_dir), in_files=True).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(documents(spark, sf_dir))


#: What a leaf of op12 is made of, in order.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = leaf_digest(*map(F.col, LEAF_FIELDS[:-1]), F.translate("text", UPPER, LOWER))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle_manifest(documents(spark, sf_dir), LEAF_FIELDS, claimed=F.when(chosen, tampered))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_benchmark_decontamination, op3_token_counts, op4_ngram_jaccard_join, op5_suffix_tree_scores, op6_bpe_round_trip, op7_exact_top_k, op8_language_id, op9_token_files, op10_sharding, op11_line_dedup, op12_merkle_manifest, op13_fill_in_middle)
}

def _merkle_sql(levels: int = 6, upper: int = 4, fanout: int = 16) -> str:
    """Trees of so many levels above the leaves of a source, and above the sources; level by level."""
    kv = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(kv, LEAF_FIELDS[:-1]))} || {kv(text)})"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: list_reduce(list_prepend(CAST(xor(c, b) AS BIGINT), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
    parts = [f"""leaf AS (
        SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS h, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(low)} END AS claimed FROM documents
    ), a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf)"""]

    def tree(t: str, n: int) -> None:
        for k in range(n):
            run = f"(PARTITION BY g, i // {fanout} ORDER BY i ROWS BETWEEN"
            parts.append(f"{t}s{k} AS (SELECT g, i, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k} WHERE n > 1)")
            parts.append(f"{t}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, i // {fanout} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {t}{k} WHERE n > 1 GROUP BY ALL))")
        parts.append(f"{t}top AS (" + " UNION ALL ".join(f"SELECT g, h FROM {t}{k} WHERE n = 1" for k in range(n + 1)) + ")")

    def fold(t: str, n: int, start: str) -> str:
        parts.append(f"{t}f0 AS ({start})")
        for k in range(n):
            parts.append(f"{t}f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.g IS NULL THEN folded ELSE sha256(s.l || folded || s.r) END AS folded, proof || coalesce(s.l || s.r, '') AS proof) FROM {t}f{k} f LEFT JOIN {t}s{k} s ON s.g = f.{t}g AND s.i = f.{t}i // {fanout**k})")
        return f"{t}f{n}"

    tree("a", levels)
    parts.append("b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS source_g FROM atop)")
    tree("b", upper)
    low_end = fold("a", levels, "SELECT doc_id, g AS ag, i AS ai, h AS leaf, coalesce(claimed, h) AS folded, '' AS proof FROM a0")
    end = fold("b", upper, f"SELECT f.*, '' AS bg, b0.i AS bi, b0.h AS subroot FROM {low_end} f JOIN b0 ON b0.source_g = f.ag")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, btop.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = btop.h AS verified FROM {end} CROSS JOIN btop"


ORACLE_SQL = {
    "op11_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines
        ), judged AS (
            SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op12_merkle_manifest": _merkle_sql(),
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
        drawn AS (
            SELECT *, list_transform([1, 9, 17, 25], lambda k: list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substring(h, k, 8), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT))), lambda x, y: 16 * x + y)) AS r
            FROM d
        ), cut AS (
            SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ), parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
