"""SQL for the queries of `docsluice.plans.queries`, for DuckDB on the same tables."""

from __future__ import annotations

from docsluice.functions.text import FREQUENT
from docsluice.operators.inject import PATTERNS
from docsluice.plans.queries import SCOPES
from docsluice.plans.tables import ID_STEP, LEAST, LINES_A_PAGE, OVERLAP, WINDOW

STEP = WINDOW - OVERLAP
assert LEAST <= OVERLAP + 1  # the last window is never evened out


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    cut = f"string_split(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: trim(s)), lambda s: s <> '')"


FILES = """files AS (
    SELECT doc_id AS file_id, 'doc_' || doc_id AS file_name, sha256(text) AS checksum, source AS doc_scope, lang AS language,
           CASE WHEN doc_id % 10 < 7 THEN 'COMPLETED' WHEN doc_id % 10 = 7 THEN 'FAILED' WHEN doc_id % 10 = 8 THEN 'PENDING' ELSE 'PROCESSING' END AS status,
           CAST(doc_id % 5 AS INTEGER) AS retry_count,
           CASE WHEN doc_id % 10 < 7 AND doc_id % 6 <> 0 THEN CAST((doc_id * 37) % 10000 / 100.0 AS DECIMAL(5,2)) END AS quality_score,
           make_timestamp((1704067200 + (doc_id * 3571) % 2592000) * 1000000) AS created_at
    FROM documents)"""

CHUNKS = f"""words AS (SELECT doc_id, {words("text")} AS w FROM documents),
counted AS (SELECT doc_id, w, len(w) AS n, CASE WHEN len(w) <= {WINDOW} THEN 1 ELSE CAST(ceil((len(w) - {WINDOW}) / {STEP}.0) AS INTEGER) + 1 END AS k FROM words WHERE len(w) > 0),
chunks AS (
    SELECT doc_id * {ID_STEP} + i AS chunk_id, doc_id AS file_id, CAST(i AS INTEGER) AS chunk_index,
           array_to_string(w[i * {STEP} + 1 : least(i * {STEP} + {WINDOW}, n)], ' ') AS chunk_text, CAST(least(i * {STEP} + {WINDOW}, n) - i * {STEP} AS INTEGER) AS token_count
    FROM (SELECT *, unnest(range(k)) AS i FROM counted))"""

BLOCKS = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS block_no FROM documents),
blocks AS (SELECT doc_id AS file_id, CAST((block_no - 1) // {LINES_A_PAGE} + 1 AS INTEGER) AS page_no, CAST(block_no AS INTEGER) AS block_no, text,
    trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS clean FROM lines),
normed AS (SELECT *, {norm("clean")} AS norm FROM blocks)"""

SIGNATURES = """paged AS (SELECT *, row_number() OVER (PARTITION BY file_id, page_no ORDER BY block_no) AS r, count(*) OVER (PARTITION BY file_id, page_no) AS m FROM normed),
edge AS (SELECT DISTINCT file_id, page_no, clean, norm FROM paged WHERE (r <= 2 OR r > m - 2) AND length(clean) <= 200 AND norm <> ''),
sig AS (SELECT file_id, norm, count(*) AS pages FROM edge GROUP BY ALL),
pages AS (SELECT file_id, count(DISTINCT page_no) AS n FROM blocks GROUP BY 1),
signatures AS (SELECT sig.* FROM sig JOIN pages USING (file_id) WHERE n >= 3 AND sig.pages >= greatest(3, ceil(n * 0.5)))"""

METRICS = """metrics AS (
    SELECT doc_id AS file_id, doc_id * 10 + n AS metric_id,
           (['intake', 'parse', 'parse', 'clean', 'chunk', 'embed'])[n + 1] AS step,
           ([true, doc_id % 3 <> 0, true, true, true, doc_id % 13 <> 0])[n + 1] AS ok,
           ([doc_id % 17, doc_id % 101, doc_id % 103, doc_id % 29, doc_id % 31, doc_id % 211])[n + 1] AS duration_ms
    FROM documents, unnest(range(6)) AS u(n))"""

SUBS = """subs AS (
    SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 97 AS DOUBLE) ELSE CAST(doc_id % 91 AS DOUBLE) END AS parse,
           round(CAST(doc_id % 11 AS DOUBLE) / 10 * 100, 2) AS clean, CAST(doc_id % 89 AS DOUBLE) AS chunk,
           CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 83 AS DOUBLE) END AS embed
    FROM documents)"""
SCORE = "round((parse * 0.35 + clean * 0.2 + chunk * 0.25 + coalesce(embed * 0.2, 0.0)) / (0.35 + 0.2 + 0.25 + CASE WHEN embed IS NULL THEN 0.0 ELSE 0.2 END), 2)"

IN_SCOPE = ", ".join(f"'{s}'" for s in SCOPES)
DENSE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


def dense(scope: str, more: str = "") -> str:
    return f"""WITH {FILES}, s AS (SELECT file_id AS chunk_id, file_name, {DENSE} AS raw FROM files JOIN embeddings ON vec_id = file_id WHERE doc_scope IN ({scope}) {more}),
    best AS (SELECT * FROM s ORDER BY raw DESC, chunk_id LIMIT 10)
    SELECT chunk_id, file_name, round(raw, 6) AS score, CAST(row_number() OVER (ORDER BY raw DESC, chunk_id) AS INTEGER) AS rank FROM best"""


def count_of(text: str, token: str) -> str:
    return f"len(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w = '{token}'))"


def lexical(scope: str, text: str, token: str) -> str:
    return f"""WITH {FILES}, s AS (SELECT doc_id AS chunk_id, file_name, {count_of(text, token)} AS n FROM documents JOIN files ON file_id = doc_id WHERE doc_scope IN ({scope})),
    best AS (SELECT * FROM s WHERE n > 0 ORDER BY n DESC, chunk_id LIMIT 10)
    SELECT chunk_id, file_name, round(n * 0.1, 6) AS score, CAST(row_number() OVER (ORDER BY n DESC, chunk_id) AS INTEGER) AS rank FROM best"""


TOKENS = "regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+')"


def several(scope: str, words_asked: list[str]) -> str:
    """Cover density of several words: each occurrence ends a stretch that begins where the word seen longest ago is."""
    m, own = len(words_asked), [f"max(p) FILTER (w = '{w}') OVER (PARTITION BY doc_id ORDER BY p)" for w in words_asked]
    return f"""WITH {FILES}, t AS (SELECT doc_id, {TOKENS.format(text=norm("text"))} AS ws FROM documents WHERE source IN ({scope})),
    o AS (SELECT * FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM t) WHERE w IN ({", ".join(f"'{w}'" for w in words_asked)})),
    l AS (SELECT doc_id, p, {", ".join(f"{x} AS l{i}" for i, x in enumerate(own))} FROM o),
    c AS (SELECT doc_id, p, least({", ".join(f"l{i}" for i in range(m))}) AS low FROM l WHERE {" AND ".join(f"l{i} IS NOT NULL" for i in range(m))}),
    n AS (SELECT *, lag(low) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM c),
    s AS (SELECT doc_id AS chunk_id, round(sum(CAST(0.1 AS DOUBLE) * {m} / (p - low + 2 - {m})), 9) AS raw FROM n WHERE before IS NULL OR low > before GROUP BY 1),
    best AS (SELECT chunk_id, file_name, raw FROM s JOIN files ON file_id = chunk_id ORDER BY raw DESC, chunk_id LIMIT 10)
    SELECT chunk_id, file_name, round(raw, 6) AS score, CAST(row_number() OVER (ORDER BY raw DESC, chunk_id) AS INTEGER) AS rank FROM best"""


def alike(scope: str, query: str, least: float) -> str:
    """Trigram similarity: the most of the query's trigrams in any run of trigrams as long as the query's."""
    grams = lambda w: f"list_transform(range(1, CAST(length({w}) AS BIGINT) + 2), lambda i: substring('  ' || {w} || ' ', i, 3))"
    asked = f"(SELECT list_distinct(flatten(list_transform(string_split('{query}', ' '), lambda w: {grams('w')}))))"
    return f"""WITH {FILES}, q AS (SELECT {asked} AS gs), t AS (SELECT doc_id, flatten(list_transform({TOKENS.format(text=norm("text"))}, lambda w: {grams("w")})) AS gs FROM documents WHERE source IN ({scope})),
    o AS (SELECT doc_id, g, p FROM (SELECT doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) AS p FROM t) WHERE list_contains((SELECT gs FROM q), g)),
    r AS (SELECT a.doc_id, a.p, count(DISTINCT b.g) AS n FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p - (SELECT len(gs) FROM q) + 1 AND a.p GROUP BY ALL),
    s AS (SELECT doc_id AS chunk_id, max(n) / (SELECT len(gs) FROM q) AS raw FROM r GROUP BY 1),
    best AS (SELECT chunk_id, file_name, raw FROM s JOIN files ON file_id = chunk_id WHERE raw >= {least} ORDER BY raw DESC, chunk_id LIMIT 10)
    SELECT chunk_id, file_name, round(raw, 6) AS score, CAST(row_number() OVER (ORDER BY raw DESC, chunk_id) AS INTEGER) AS rank FROM best"""


def hybrid(score: str, digits: int) -> str:
    return f"""WITH {FILES},
    d AS (SELECT *, row_number() OVER (ORDER BY s DESC, chunk_id) AS r FROM (SELECT file_id AS chunk_id, {DENSE} AS s FROM files JOIN embeddings ON vec_id = file_id WHERE doc_scope IN ({IN_SCOPE}) ORDER BY s DESC, chunk_id LIMIT 10)),
    l AS (SELECT *, row_number() OVER (ORDER BY s DESC, chunk_id) AS r FROM (SELECT doc_id AS chunk_id, {count_of(norm("text"), "the")} * 0.1 AS s FROM documents WHERE source IN ({IN_SCOPE}) AND {count_of(norm("text"), "the")} > 0 ORDER BY s DESC, chunk_id LIMIT 10)),
    f AS (SELECT chunk_id, {score} AS raw, CAST(d.r AS INTEGER) AS dense_rank, CAST(l.r AS INTEGER) AS sparse_rank FROM d FULL JOIN l USING (chunk_id)),
    best AS (SELECT * FROM f ORDER BY raw DESC, chunk_id LIMIT 10)
    SELECT chunk_id, round(raw, {digits}) AS score, CAST(row_number() OVER (ORDER BY raw DESC, chunk_id) AS INTEGER) AS rank, dense_rank, sparse_rank FROM best"""


RETRIEVED = f"""{FILES}, {CHUNKS},
retrieved AS (
    SELECT file_id AS query_id, chunk_index AS pos, chunk_id, chunk_id * 37 % 101 / 100.0 AS score FROM chunks
    UNION ALL SELECT file_id, chunk_index + 100000, chunk_id, chunk_id * 53 % 101 / 100.0 FROM chunks WHERE chunk_index % 5 = 0),
unique_chunks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, pos) AS r FROM retrieved) WHERE r = 1)"""
MERGED = f"""{RETRIEVED},
listed AS (SELECT query_id, pos, chunk_id, CAST(score AS DOUBLE) AS score, chunk_index, chunk_text, token_count, file_name, quality_score FROM unique_chunks JOIN chunks USING (chunk_id) JOIN files USING (file_id)),
marked AS (SELECT *, CASE WHEN chunk_index = lag(chunk_index) OVER (PARTITION BY query_id ORDER BY pos) + 1 THEN 0 ELSE 1 END AS new FROM listed),
merged AS (SELECT *, CAST(sum(new) OVER (PARTITION BY query_id ORDER BY pos) AS BIGINT) AS block FROM marked)"""
PAGE = "CAST(chunk_index // 4 + 1 AS INTEGER)"
BUDGETED = f"""{MERGED},
grouped AS (SELECT query_id, block, max(score) AS score, min(pos) AS pos, sum(token_count) AS token_count, string_agg(chunk_text, chr(10) ORDER BY pos) AS text, count(*) AS chunks,
    arg_min(file_name || ', s.' || {PAGE}, pos) AS label, coalesce(bool_or(quality_score < 70), false) AS low_quality FROM merged GROUP BY ALL),
sized AS (SELECT *, len({words("'[1] ' || label || chr(10) || text")}) AS n FROM grouped),
budgeted AS (SELECT *, floor(sum(n) OVER (PARTITION BY query_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) * 1.1) <= 500 AS kept FROM sized)"""

CITES = f"""a AS (SELECT conv_id * 1000 + turn AS answer_id, text AS answer, {sentences("text")} AS ss FROM conversations WHERE role = 'assistant'),
c AS (
    SELECT answer_id, answer, coalesce(ss[1], '') AS claim, 1 AS n, CAST(answer_id AS VARCHAR) AS chunk_id, substring(answer, 1, 20) AS quote FROM a
    UNION ALL SELECT answer_id, answer, coalesce(ss[1], ''), 2, CAST(answer_id AS VARCHAR), 'no such quote' FROM a WHERE answer_id % 3 = 1
    UNION ALL SELECT answer_id, answer, coalesce(ss[1], ''), 3, 'x1', '' FROM a WHERE answer_id % 3 = 1
    UNION ALL SELECT answer_id, answer, coalesce(ss[1], ''), 4, '-7', '' FROM a WHERE answer_id % 3 = 2)"""

GOLD = f"""gold AS (SELECT DISTINCT item_id AS id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains({norm("d.text")}, {norm("b.text")}) WHERE {norm("b.text")} <> '')"""
#: Measures of `ranked` (id, chunk_id of the gold, its rank or null) for the questions `q` (id, category).
MEASURED = """per AS (SELECT id, count(*) AS g, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20, min(rank) AS first,
    sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END) AS d5, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS d10, sum(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) END) AS d20 FROM ranked GROUP BY id),
measured AS (SELECT q.id, category, coalesce(h5 / g, 0.0) AS recall_at_5, coalesce(h10 / g, 0.0) AS recall_at_10, coalesce(h20 / g, 0.0) AS recall_at_20, coalesce(1.0 / first, 0.0) AS mrr,
    coalesce(d5 / list_sum(list_transform(range(1, least(g, 5) + 1), lambda i: 1 / log2(i + 1))), 0.0) AS ndcg_at_5, coalesce(d10 / list_sum(list_transform(range(1, least(g, 10) + 1), lambda i: 1 / log2(i + 1))), 0.0) AS ndcg_at_10,
    coalesce(d20 / list_sum(list_transform(range(1, least(g, 20) + 1), lambda i: 1 / log2(i + 1))), 0.0) AS ndcg_at_20
    FROM q LEFT JOIN per ON q.id = per.id)"""
RANKED = f"""{GOLD}, ranked AS (SELECT id, chunk_id, 1 + (id + chunk_id) % 12 AS rank FROM gold),
q AS (SELECT item_id AS id, 'c' || item_id % 3 AS category FROM benchmark), {MEASURED}"""

EVIDENCE = "e AS (SELECT item_id AS id, text AS quote, 'doc_' || item_id * 7 % 100 AS file_name, 'src' || item_id % 20 AS doc_scope FROM benchmark)"

_ARRIVALS = """known AS (SELECT 'doc_' || doc_id AS file_name, sha256(text) AS checksum, 1 AS doc_version FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
arrivals AS (
    SELECT doc_id * 2 AS arrival_no, 'doc_' || doc_id AS file_name, CASE WHEN doc_id % 11 <> 5 THEN 'txt' END AS file_type, sha256(text) AS checksum, CASE WHEN doc_id % 13 = 4 THEN 209715200 ELSE n_chars END AS file_size FROM documents
    UNION ALL SELECT doc_id * 2 + 1, 'doc_' || doc_id, 'txt', sha256(sha256(text) || '2'), n_chars FROM documents),
fresh AS (SELECT *, file_type IS NOT NULL AND checksum NOT IN (SELECT checksum FROM known) AND row_number() OVER (PARTITION BY checksum, file_type IS NOT NULL ORDER BY arrival_no) = 1 AS fresh FROM arrivals),
versions AS (SELECT *, coalesce((SELECT max(doc_version) FROM known k WHERE k.file_name = fresh.file_name), 0) + sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY file_name ORDER BY arrival_no) AS v FROM fresh),
taken AS (SELECT arrival_no, CASE WHEN file_type IS NULL THEN 'REJECTED' WHEN NOT fresh THEN 'SKIPPED' WHEN file_size > 104857600 THEN 'FAILED' WHEN v > 1 THEN 'VERSIONED' ELSE 'CREATED' END AS outcome, CASE WHEN fresh THEN CAST(v AS INTEGER) END AS doc_version FROM versions)"""


def injection(table: str, key: str, column: str) -> str:
    found = lambda p: f"len(regexp_extract_all({column}, '{p}'))"
    patterns = " + ".join(found("(?i)" + p.replace("'", "''")) for p in PATTERNS)
    hidden = found("[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]")
    base64 = f"len(list_filter(regexp_extract_all({column}, '[A-Za-z0-9+/]{{40,}}={{0,2}}'), lambda x: regexp_matches(x, '[+/]|=$')))"
    mixed = f"len(list_filter(regexp_extract_all({column}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '\\p{{Latin}}') AND regexp_matches(x, '[\\p{{Cyrillic}}\\p{{Greek}}]')))"
    return f"""WITH c AS (SELECT {key} AS id, CAST({patterns} AS INTEGER) AS pattern_count, CAST({hidden} AS INTEGER) AS hidden_count, CAST({base64} AS INTEGER) AS base64_count, CAST({mixed} AS INTEGER) AS homoglyph_count FROM {table})
    SELECT *, pattern_count >= 1 OR base64_count >= 1 OR hidden_count >= 1 OR homoglyph_count >= 2 AS injection_flag FROM c"""


FINDINGS = f"""{CHUNKS},
n AS (SELECT *, {norm("chunk_text")} AS norm FROM chunks),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, norm ORDER BY chunk_index) AS k FROM n),
findings AS (
    SELECT file_id, chunk_id, 'empty_chunk' AS finding FROM r WHERE norm = ''
    UNION ALL SELECT file_id, chunk_id, 'too_short' FROM r WHERE norm <> '' AND token_count < 20
    UNION ALL SELECT file_id, chunk_id, 'too_long' FROM r WHERE norm <> '' AND token_count > 60
    UNION ALL SELECT file_id, chunk_id, 'duplicate_chunk' FROM r WHERE norm <> '' AND k > 1)"""

_LISTED = f"ids AS (SELECT unnest(range(8)) AS pos, unnest([5, 3, 999999999, 3, 8, 21, 13, 0]) AS chunk_id), l AS (SELECT CAST(pos AS INTEGER) AS pos, CAST(chunk_id AS BIGINT) AS chunk_id, text FROM ids JOIN documents ON doc_id = chunk_id)"
_TABLED = f"{CHUNKS}, c AS (SELECT *, chunk_index % 9 = 8 AS is_table, chunk_index % 3 = 0 AS has_section, chunk_index % 2 = 0 AS has_span FROM chunks)"

ORACLE_SQL: dict[str, str] = {
    "retrieval_dense_topk": dense(IN_SCOPE),
    "retrieval_dense_filtered": dense(IN_SCOPE, "AND language = 'en' AND CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"),
    "filter_date_range": "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1",
    "retrieval_sparse_simple": lexical(IN_SCOPE, norm("text"), "the"),
    "retrieval_sparse_unaccent": lexical("'src5', 'src6', 'src7'", f"strip_accents({norm('text')})", "a"),
    "retrieval_sparse_several": several(IN_SCOPE, ["with", "that"]),
    "retrieval_sparse_trgm": alike(IN_SCOPE, "nation retion", 0.2),
    "lexical_index": f"WITH t AS (SELECT doc_id, unnest({TOKENS.format(text=norm('text'))}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS chunks, count(*) AS occurrences FROM t GROUP BY 1",
    "retrieval_hybrid_rrf": hybrid("coalesce(1.0 / (60 + d.r), 0.0) + coalesce(1.0 / (60 + l.r), 0.0)", 9),
    "retrieval_hybrid_weighted": hybrid("0.8 * coalesce(d.s, 0.0) + 0.2 * coalesce(l.s, 0.0)", 6),
    "retrieval_batch_multi_query": """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
        s AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS raw FROM embeddings JOIN documents ON doc_id = vec_id, q),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM s)
        SELECT query_id, chunk_id, round(raw, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
    "lookup_neighbors": f"""WITH {FILES}, {CHUNKS}, s AS (SELECT c.*, file_name FROM chunks c JOIN files USING (file_id) WHERE doc_scope IN ({IN_SCOPE}))
        SELECT a.chunk_id AS anchor_id, b.chunk_id, b.chunk_index, b.file_name, md5(b.chunk_text) AS text_md5 FROM s a JOIN s b ON a.file_id = b.file_id AND b.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 2""",
    "lookup_page": f"WITH {CHUNKS} SELECT chunk_id, chunk_index, md5(chunk_text) AS text_md5 FROM chunks WHERE file_id = 0 AND chunk_index // 4 + 1 = 1",
    "rerank_texts_ordered": f"WITH {_LISTED} SELECT pos, chunk_id, 0.0::DOUBLE AS score, md5(text) AS text_md5 FROM l",
    "rerank_scored": f"WITH {_LISTED} SELECT pos, chunk_id, CAST(len({words('text')}) AS DOUBLE) AS score FROM l ORDER BY score DESC, pos LIMIT 4",
    "context_dedup": f"WITH {RETRIEVED} SELECT query_id, pos, chunk_id, CAST(score AS DOUBLE) AS score FROM unique_chunks",
    "context_dedup_first_place": f"WITH {RETRIEVED} SELECT query_id, min(pos) AS pos, chunk_id, CAST(max(score) AS DOUBLE) AS score FROM retrieved GROUP BY query_id, chunk_id",
    "context_merge": f"WITH {MERGED} SELECT query_id, block, count(*) AS chunks, min(pos) AS pos, max(score) AS score, CAST(sum(token_count) AS BIGINT) AS token_count FROM merged GROUP BY ALL",
    "context_budget": f"WITH {BUDGETED} SELECT query_id, block, kept FROM budgeted",
    "context_render": f"""WITH {BUDGETED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n2 FROM budgeted WHERE kept)
        SELECT query_id, CAST(n2 AS INTEGER) AS n, '[' || n2 || '] ' || label AS label, CAST(token_count AS BIGINT) AS token_count, low_quality, CAST(chunks AS INTEGER) AS chunks, md5(text) AS text_md5 FROM k""",
    "normalize_text": f"SELECT doc_id, md5({norm('text')}) AS norm_md5 FROM documents",
    "clean_blocks": f"WITH {BLOCKS} SELECT file_id, block_no, md5(clean) AS clean_md5, clean = '' AS blank FROM blocks",
    "clean_boilerplate": f"WITH {BLOCKS}, {SIGNATURES} SELECT file_id, md5(norm) AS norm_md5, pages FROM signatures",
    "clean_metrics": f"""WITH {BLOCKS}, {SIGNATURES}, m AS (SELECT n.*, s.norm IS NOT NULL AS sig FROM normed n LEFT JOIN signatures s ON n.file_id = s.file_id AND n.norm = s.norm),
        p AS (SELECT file_id, page_no, sum(length(text)) + count(*) - 1 AS b, coalesce(sum(length(clean) + 1) FILTER (clean <> '' AND NOT sig) - 1, 0) AS a, count(*) FILTER (clean = '') AS blank, count(*) FILTER (clean <> '' AND sig) AS rep FROM m GROUP BY ALL),
        f AS (SELECT file_id, CAST(sum(b) + count(*) - 1 AS BIGINT) AS original_chars, CAST(sum(a) + count(*) - 1 AS BIGINT) AS cleaned_chars, CAST(sum(blank) AS BIGINT) AS blank_blocks_removed, CAST(sum(rep) AS BIGINT) AS header_footer_removed FROM p GROUP BY 1)
        SELECT *, greatest(0, original_chars - cleaned_chars) AS removed_chars, round(CASE WHEN original_chars > 0 THEN cleaned_chars / original_chars ELSE 1.0 END, 4) AS retention_ratio FROM f""",
    "chunk_sliding": f"WITH {CHUNKS} SELECT file_id, chunk_index, token_count, md5(chunk_text) AS text_md5 FROM chunks",
    "chunk_metrics_by_file": f"""WITH {_TABLED}, m AS (SELECT file_id, count(*) AS chunk_count, round(avg(token_count), 2) AS token_avg, round(quantile_cont(token_count, 0.95), 2) AS token_p95, max(token_count) AS token_max,
        avg(CAST(token_count < 20 AS DOUBLE)) AS b, avg(CAST(token_count >= {WINDOW} AS DOUBLE)) AS t, coalesce(avg(CAST(has_section AS DOUBLE)) FILTER (NOT is_table), 0) AS s, count(*) FILTER (is_table) AS table_chunks FROM c GROUP BY 1)
        SELECT file_id, chunk_count, token_avg, token_p95, token_max, round(b, 4) AS below_min_ratio, round(t, 4) AS truncated_ratio, round(s, 4) AS section_alignment_ratio, table_chunks, round(100.0 * (1 - t) * (1 - b), 2) AS chunk_score FROM m""",
    "chunk_metadata_fill": f"WITH {_TABLED} SELECT file_id, count(*) AS chunk_count, 1.0::DOUBLE AS page_number_fill, 0.0::DOUBLE AS sheet_name_fill, round(avg(CAST(has_section AS DOUBLE)), 4) AS section_title_fill, round(avg(CAST(has_span AS DOUBLE)), 4) AS char_span_fill FROM c GROUP BY 1",
    "parse_metrics": f"""WITH {BLOCKS}, p AS (SELECT file_id, page_no, max(CAST(trim(text) <> '' AS INTEGER)) AS t, sum(length(text)) + count(*) - 1 AS n FROM blocks GROUP BY ALL),
        f AS (SELECT file_id, avg(CAST(t AS DOUBLE)) AS share, CAST(max(t) AS DOUBLE) AS anything, count(*) AS pages, sum(n) + count(*) - 1 + 1 AS chars FROM p GROUP BY 1),
        c AS (SELECT *, CASE WHEN file_id % 2 = 0 THEN share ELSE anything END AS cov FROM f)
        SELECT file_id, round(cov, 4) AS coverage, round(cov, 4) AS page_ratio, 0.0::DOUBLE AS garbage_ratio, CAST(pages AS INTEGER) AS page_count, CAST(chars AS INTEGER) AS char_count, round(100.0 * cov, 2) AS parse_score FROM c""",
    "injection_scan": injection("documents", "doc_id", "text"),
    "injection_scan_pages": injection("pages", "page_id", "html"),
    "qc_chunk_findings": f"WITH {FINDINGS} SELECT * FROM findings",
    "quality_score": f"WITH {SUBS} SELECT *, {SCORE} AS quality_score FROM subs",
    "embed_metrics": """WITH n AS (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)
        SELECT label, count(*) AS expected, count(*) AS embedded, CAST(0 AS BIGINT) AS failed, round(avg(norm), 5) AS norm_mean, round(stddev_pop(norm), 5) AS norm_std, 100.0::DOUBLE AS embed_score FROM n GROUP BY 1""",
    "embed_anomaly": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), k AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM f WHERE r <= 50),
        p AS (SELECT a.label, avg(list_cosine_similarity(a.v, b.v)) AS m FROM k a JOIN k b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1), c AS (SELECT label, count(*) AS vectors FROM k GROUP BY 1)
        SELECT label, vectors, round(coalesce(m, 0.0), 6) AS mean_cosine, coalesce(m, 0.0) > 0.98 AS anomaly FROM c LEFT JOIN p USING (label)""",
    "orphan_vectors": "SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "report_status": f"WITH {FILES} SELECT status, count(*) AS files FROM files GROUP BY 1",
    "report_parse_rate": f"""WITH {FILES}, {METRICS}, x AS (SELECT count(*) AS total_files, count(*) FILTER (status IN ('COMPLETED', 'FAILED')) AS terminal_files,
        count(*) FILTER (status IN ('COMPLETED', 'FAILED') AND file_id IN (SELECT file_id FROM metrics WHERE step = 'parse' AND ok)) AS parse_ok FROM files)
        SELECT *, total_files - terminal_files AS pending_files, round(parse_ok / terminal_files, 4) AS parse_success_rate, parse_ok / terminal_files >= 0.95 AS parse_success_met FROM x""",
    "report_step_avg": f"WITH {METRICS} SELECT step, round(avg(duration_ms), 1) AS avg_ms FROM metrics GROUP BY 1",
    "report_chunk_stats": f"WITH {CHUNKS} SELECT count(*) AS chunks, round(avg(token_count), 1) AS token_avg, round(quantile_cont(token_count, 0.95), 3) AS token_p95 FROM chunks",
    "report_quality_dist": f"WITH {FILES} SELECT min(CAST(quality_score AS DOUBLE)) AS lowest, round(avg(CAST(quality_score AS DOUBLE)), 2) AS mean, round(quantile_cont(CAST(quality_score AS DOUBLE), 0.95), 3) AS p95, count(*) AS scored_files FROM files WHERE quality_score IS NOT NULL",
    "report_lowest": f"WITH {FILES} SELECT file_id, file_name, CAST(quality_score AS DOUBLE) AS quality_score FROM files WHERE quality_score IS NOT NULL ORDER BY quality_score, file_id LIMIT 10",
    "report_open_findings": f"WITH {FINDINGS} SELECT finding, count(*) AS findings FROM findings WHERE chunk_id % 3 <> 0 GROUP BY 1",
    "report_cross_dupes": f"WITH {CHUNKS} SELECT count(*) AS groups FROM (SELECT {norm('chunk_text')} AS k FROM chunks GROUP BY 1 HAVING count(DISTINCT file_id) > 1)",
    "report_recovered": f"WITH {FILES}, {METRICS} SELECT count(*) AS recovered_files FROM files f WHERE status = 'COMPLETED' AND (retry_count > 0 OR EXISTS (SELECT 1 FROM metrics m WHERE m.file_id = f.file_id AND NOT m.ok))",
    "eval_gold_map": f"WITH {GOLD} SELECT id, chunk_id FROM gold",
    "eval_mapping_rate": f"WITH {GOLD}, r AS (SELECT (SELECT count(*) FROM benchmark) AS evidences, (SELECT count(DISTINCT id) FROM gold) AS mapped) SELECT evidences, mapped, round(mapped / evidences, 4) AS rate FROM r",
    "eval_validate_evidence": f"""WITH {FILES}, {EVIDENCE}, done AS (SELECT f.*, text FROM files f JOIN documents ON doc_id = file_id WHERE status = 'COMPLETED')
        SELECT id, EXISTS (SELECT 1 FROM done WHERE done.file_name = e.file_name AND done.doc_scope = e.doc_scope) AS file_exists,
               EXISTS (SELECT 1 FROM done WHERE done.file_name = e.file_name AND done.doc_scope = e.doc_scope AND contains({norm('done.text')}, {norm('e.quote')})) AS quote_found FROM e""",
    "eval_metrics": f"WITH {RANKED} SELECT id, category, {', '.join(f'round({m}, 6) AS {m}' for m in ('recall_at_5', 'recall_at_10', 'recall_at_20', 'mrr', 'ndcg_at_5', 'ndcg_at_10', 'ndcg_at_20'))} FROM measured",
    "eval_aggregate": f"WITH {RANKED} SELECT category, count(*) AS n, round(avg(recall_at_5), 4) AS recall_at_5, round(avg(recall_at_10), 4) AS recall_at_10, round(avg(mrr), 4) AS mrr, round(avg(ndcg_at_10), 4) AS ndcg_at_10 FROM measured GROUP BY ROLLUP (category)",
    "grounding_validate": f"""WITH {CITES},
        j AS (SELECT *, CASE WHEN TRY_CAST(chunk_id AS BIGINT) IS NULL THEN 'malformed_citation' WHEN TRY_CAST(chunk_id AS BIGINT) <> answer_id THEN 'citation_not_in_context:' || chunk_id
            WHEN {norm('quote')} <> '' AND NOT contains({norm('answer')}, {norm('quote')}) THEN 'fabricated_quote:' || chunk_id END AS issue FROM c),
        g AS (SELECT answer_id, list(issue ORDER BY n) FILTER (issue IS NOT NULL) AS bad, list({norm('claim')}) FILTER (issue IS NULL AND {norm('claim')} <> '') AS claims FROM j GROUP BY 1),
        v AS (SELECT answer_id, answer, coalesce(bad, []) AS bad, CASE WHEN len(ss) > 0 THEN len(list_filter(ss, lambda s: len(list_filter(coalesce(claims, []), lambda k: {norm('s')} <> '' AND (contains({norm('s')}, k) OR contains(k, {norm('s')})))) > 0)) / len(ss) ELSE 0.0 END AS cov FROM a LEFT JOIN g USING (answer_id)),
        i AS (SELECT *, list_concat(bad, list_filter([CASE WHEN cov < 0.3 THEN 'low_coverage:' || printf('%.3f', cov) END, CASE WHEN contains(lower(answer), 'bulunamad') THEN 'answer_claims_no_info_despite_context' END], lambda x: x IS NOT NULL)) AS issues FROM v)
        SELECT answer_id, round(cov, 6) AS coverage, array_to_string(issues, ';') AS issues, len(issues) = 0 AS passed, CASE WHEN cov >= 0.9 THEN 'high' WHEN cov > 0 THEN 'medium' ELSE 'low' END AS confidence FROM i""",
    "sentence_coverage": f"""WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, {sentences('text')} AS ss FROM conversations WHERE role = 'assistant'),
        n AS (SELECT answer_id, ss, list_transform(ss[1:2], lambda s: {norm('s')}) AS claims FROM a)
        SELECT answer_id, CAST(len(ss) AS INTEGER) AS sentences, round(CASE WHEN len(ss) > 0 THEN len(list_filter(ss, lambda s: len(list_filter(claims, lambda k: k <> '' AND {norm('s')} <> '' AND (contains({norm('s')}, k) OR contains(k, {norm('s')})))) > 0)) / len(ss) ELSE 0.0 END, 6) AS coverage FROM n""",
    "compose_sources": f"WITH {CITES} SELECT answer_id, CAST(n AS INTEGER) AS n, 'answer_' || chunk_id AS file_name, 1 AS page_number, CAST(chunk_id AS BIGINT) AS chunk_id, quote FROM c WHERE TRY_CAST(chunk_id AS BIGINT) = answer_id",
    "session_history": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n, role, md5(text) AS text_md5 FROM conversations",
    "intake_dedup_version": f"WITH {_ARRIVALS} SELECT * FROM taken",
    "intake_outcomes": f"WITH {_ARRIVALS} SELECT o AS outcome, (SELECT count(*) FROM taken WHERE outcome = o) AS files FROM unnest(['CREATED', 'VERSIONED', 'SKIPPED', 'FAILED', 'REJECTED']) AS u(o)",
    "retry_select": f"WITH {FILES} SELECT file_id, 'PENDING' AS status, retry_count + 1 AS retry_count FROM files WHERE status = 'FAILED' AND retry_count < 3",
    "stuck_recover": f"WITH {FILES} SELECT file_id, 'PENDING' AS status, retry_count + 1 AS retry_count FROM files WHERE status = 'PROCESSING' AND created_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTES",
    "reprocess_point": "SELECT doc_id AS file_id, CASE WHEN doc_id % 4 <> 0 THEN 'parse' ELSE 'intake' END AS start FROM documents",
    "score_backfill": f"WITH {FILES}, {SUBS} SELECT file_id, CASE WHEN status = 'COMPLETED' AND quality_score IS NULL THEN CAST(CAST({SCORE} AS DECIMAL(5,2)) AS DOUBLE) ELSE CAST(quality_score AS DOUBLE) END AS quality_score FROM files JOIN subs USING (file_id)",
    "stream_intake": "SELECT DISTINCT sha256(text) AS checksum FROM documents",
}

ORACLE_SQL["ingest_states"] = f"""WITH {FILES}, due AS (SELECT file_id, CAST(retry_count + CASE WHEN status = 'PROCESSING' THEN 1 ELSE 0 END AS INTEGER) AS retry_count FROM files
    WHERE status = 'PENDING' OR status = 'PROCESSING' AND created_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTES),
    parsed AS ({ORACLE_SQL["parse_metrics"]}), cleaned AS ({ORACLE_SQL["clean_metrics"]}),
    r AS (SELECT file_id, retry_count, CASE WHEN coverage IS NULL THEN 'parse: no result' WHEN coverage < 0.5 OR garbage_ratio > 0.2 THEN 'parse: coverage or junk beyond the limit'
        WHEN retention_ratio < 0.6 THEN 'clean: too little is left' END AS fail_reason FROM due LEFT JOIN parsed USING (file_id) LEFT JOIN cleaned USING (file_id))
    SELECT file_id, CASE WHEN fail_reason IS NULL THEN 'PROCESSING' ELSE 'FAILED' END AS status, fail_reason, retry_count FROM r"""

ORACLE_SQL["eval_dense_run"] = f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT a.vec_id AS id, b.vec_id AS chunk_id, list_cosine_similarity(b.v, a.v) AS raw FROM v a, v b JOIN documents ON doc_id = b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY raw DESC, chunk_id) AS rank FROM s),
    gold AS (SELECT a.vec_id AS id, b.vec_id AS chunk_id FROM v a JOIN v b ON a.vec_id // 50 = b.vec_id // 50 AND a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    ranked AS (SELECT gold.*, r.rank FROM gold LEFT JOIN r ON gold.id = r.id AND gold.chunk_id = r.chunk_id AND r.rank <= 20),
    q AS (SELECT vec_id AS id, 'l' || label AS category FROM v WHERE vec_id % 50 = 0), {MEASURED}
    SELECT id, category, {", ".join(f"round({m}, 6) AS {m}" for m in ("recall_at_5", "recall_at_10", "recall_at_20", "mrr", "ndcg_at_5", "ndcg_at_10", "ndcg_at_20"))} FROM measured"""

_HITS = " UNION ALL ".join(f"SELECT doc_id, text, '{lang}' AS lang, len(list_filter(w, lambda x: list_contains({these.split()!r}, x))) AS n FROM t" for lang, these in sorted(FREQUENT.items()))
ORACLE_SQL["parse_language"] = f"""WITH t AS (SELECT doc_id, text, string_split_regex(regexp_replace(lower(text), '[\\p{{P}}\\p{{S}}\\d]+', ' ', 'g'), '\\s+') AS w FROM documents),
    h AS ({_HITS}), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS place FROM h)
    SELECT doc_id, CASE WHEN length(trim(text)) >= 20 AND n > 0 THEN lang END AS language FROM b WHERE place = 1"""

ORACLE_SQL["retrieval_dense_indexed"] = ORACLE_SQL["retrieval_dense_topk"]
ORACLE_SQL["retrieval_batch_indexed"] = ORACLE_SQL["retrieval_batch_multi_query"]


def _walk(name: str, rows: str, fits: str, held: str) -> str:
    """Groups of the rows (file_id, i from 1, n) of a file, one after the other: `fits` says whether a row joins the group
    so far, which holds `held`."""
    return f"""{name} AS (
        SELECT file_id, i, 1 AS seg, n AS held FROM {rows} WHERE i = 1
        UNION ALL SELECT c.file_id, c.i, CASE WHEN {fits} THEN w.seg ELSE w.seg + 1 END, CASE WHEN {fits} THEN {held} ELSE c.n END FROM {name} w JOIN {rows} c ON c.file_id = w.file_id AND c.i = w.i + 1)"""


_MERGE = _walk("merges", "pieces", f"c.n < {LEAST} AND w.held + c.n <= {WINDOW}", "w.held + c.n")
ORACLE_SQL["chunk_min_merge"] = f"""WITH RECURSIVE {BLOCKS},
    pieces AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY block_no) AS i, len({words("text")}) AS n FROM blocks WHERE trim(text) <> ''), {_MERGE}
    SELECT file_id, CAST(seg - 1 AS INTEGER) AS chunk_index, CAST(sum(n) AS INTEGER) AS token_count, arg_min(page_no, i) AS page_number, md5(string_agg(text, chr(10) ORDER BY i)) AS text_md5
    FROM pieces JOIN merges USING (file_id, i) GROUP BY file_id, seg"""


def chunked(strategy: str) -> str:
    """Sections where a line is a section's title, else packed paragraphs, else the whole; windows over each; short ones merged."""
    key = f"CASE WHEN block_no % 7 = 1 AND length(text) BETWEEN 1 AND 60 THEN {norm('text')} END"
    titles = f"titles AS (SELECT file_id, {key} AS key, arg_max(text, block_no) AS title FROM blocks WHERE {key} <> '' {'' if strategy == 'section' else 'AND false'} GROUP BY ALL)"
    return f"""WITH RECURSIVE {BLOCKS}, {titles},
    lined AS (SELECT b.*, title, row_number() OVER w AS i, coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start, len({words("text")}) AS n
        FROM blocks b LEFT JOIN titles t ON t.file_id = b.file_id AND t.key = {norm("b.text")} WHERE b.text <> '' WINDOW w AS (PARTITION BY b.file_id ORDER BY page_no, block_no)),
    units AS (SELECT *, char_start + length(text) AS char_end, last_value(title IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY i) AS section FROM lined),
    {_walk("packs", "units", f"w.held + c.n <= {WINDOW}", "w.held + c.n")},
    parted AS (SELECT units.*, packs.seg AS pack, CASE WHEN i = 1 OR section IS DISTINCT FROM lag(section) OVER (PARTITION BY file_id ORDER BY i) THEN 1 ELSE 0 END AS new, bool_or(section IS NOT NULL) OVER (PARTITION BY file_id) AS matched FROM units JOIN packs USING (file_id, i)),
    placed AS (SELECT *, CASE WHEN matched THEN sum(new) OVER (PARTITION BY file_id ORDER BY i) ELSE pack END AS seg FROM parted),
    segs AS (SELECT file_id, seg, min(char_start) AS seg_start, string_agg(text, chr(10) ORDER BY i) AS text FROM placed GROUP BY ALL),
    tokens AS (SELECT *, regexp_extract_all(text, '\\s*\\S+') AS tk FROM segs),
    counted AS (SELECT *, len(tk) AS n, unnest(range(CASE WHEN len(tk) <= {WINDOW} THEN 1 ELSE CAST(ceil((len(tk) - {WINDOW}) / {STEP}.0) AS INTEGER) + 1 END)) AS k FROM tokens WHERE len(tk) > 0),
    cut AS (SELECT file_id, seg, seg_start, tk, k * {STEP} AS a, least(k * {STEP} + {WINDOW}, n) AS b FROM counted),
    windows AS (SELECT file_id, seg, b - a AS n, array_to_string(tk[a + 1 : b], '') AS raw, seg_start + coalesce(list_sum(list_transform(tk[1 : a], lambda x: length(x))), 0) AS raw_start, seg_start + list_sum(list_transform(tk[1 : b], lambda x: length(x))) AS char_end FROM cut),
    bare AS (SELECT *, regexp_replace(raw, '^\\s+', '') AS text, raw_start + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS char_start FROM windows),
    pieces AS (SELECT b.*, row_number() OVER (PARTITION BY file_id ORDER BY seg, char_start) AS i,
        (SELECT arg_min(struct_pack(p := u.page_no, s := u.section), u.i) FROM placed u WHERE u.file_id = b.file_id AND u.seg = b.seg AND b.char_start BETWEEN u.char_start AND u.char_end) AS label FROM bare b),
    {_MERGE}
    SELECT file_id, CAST(m.seg - 1 AS INTEGER) AS chunk_index, CAST(sum(n) AS INTEGER) AS token_count, arg_min(label.p, i) AS page_number, max(label.s) FILTER (begins) AS section_title,
        CAST(min(char_start) AS INTEGER) AS char_start, CAST(arg_max(char_end, i) AS INTEGER) AS char_end, md5(string_agg(text, chr(10) ORDER BY i)) AS text_md5
    FROM (SELECT pieces.* EXCLUDE (seg), merges.seg, i = min(i) OVER (PARTITION BY file_id, merges.seg) AS begins FROM pieces JOIN merges USING (file_id, i)) m GROUP BY file_id, m.seg"""


ORACLE_SQL["chunk_section"], ORACLE_SQL["chunk_paragraph"] = chunked("section"), chunked("paragraph")

ORACLE_SQL["ingest_run"] = f"""WITH {FILES}, {BLOCKS}, {SIGNATURES}, r AS ({ORACLE_SQL["ingest_states"]}),
    w AS (SELECT n.file_id, sum(len({words("clean")})) AS n FROM normed n LEFT JOIN signatures s ON s.file_id = n.file_id AND s.norm = n.norm WHERE clean <> '' AND s.norm IS NULL GROUP BY 1)
    SELECT f.file_id, CASE WHEN r.status = 'PROCESSING' THEN 'COMPLETED' ELSE coalesce(r.status, f.status) END AS status, r.fail_reason, coalesce(r.retry_count, f.retry_count) AS retry_count,
        CAST(CASE WHEN r.status IS DISTINCT FROM 'PROCESSING' OR coalesce(n, 0) = 0 THEN 0 WHEN n <= {WINDOW} THEN 1 ELSE ceil((n - {WINDOW}) / {STEP}.0) + 1 END AS BIGINT) AS chunks
    FROM files f LEFT JOIN r ON r.file_id = f.file_id LEFT JOIN w ON w.file_id = f.file_id"""

ORACLE_SQL["golden_load"] = """SELECT CAST(item_id AS VARCHAR) AS id, 'q ' || item_id AS question, 1 AS evidences, '["created", "unchanged"]' AS outcomes FROM benchmark"""
ORACLE_SQL["golden_faults"] = """WITH r AS (SELECT item_id AS i, item_id // 100 AS part, item_id % 19 = 1 AS broken, CASE WHEN item_id % 13 = 5 THEN 'same' END AS same,
        CAST(count(*) OVER w + count(*) FILTER (item_id % 5 = 0) OVER w AS BIGINT) AS line FROM benchmark WINDOW w AS (PARTITION BY item_id // 100 ORDER BY item_id)),
    f AS (SELECT first_value(line) OVER (ORDER BY CAST(part AS VARCHAR), line) AS first, i, row_number() OVER (ORDER BY CAST(part AS VARCHAR), line) AS n FROM r WHERE NOT broken AND same IS NOT NULL),
    p AS (SELECT part, line, 'no record' AS problem FROM r WHERE broken
        UNION ALL SELECT part, line, 'unknown field extra' FROM r WHERE NOT broken AND i % 7 = 2
        UNION ALL SELECT part, line, 'evidence needs a page or a sheet, not both' FROM r WHERE NOT broken AND i % 11 = 3
        UNION ALL SELECT part, line, 'unknown category' FROM r WHERE NOT broken AND i % 17 = 4
        UNION ALL SELECT part, line, 'id of line ' || first FROM r JOIN f USING (i) WHERE n > 1)
    SELECT part, line, problem FROM p"""


def _spans(i: int, pattern: str) -> str:
    p = "(?i)" + pattern.replace("'", "''")
    return f"""SELECT doc_id AS id, {i} AS pattern, unnest(list_transform(range(1, len(m) + 1), lambda k: coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))) AS start, unnest(list_transform(m, lambda x: length(x))) AS size
        FROM (SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM documents WHERE regexp_matches(text, '{p}'))"""


ORACLE_SQL["injection_spans"] = f"WITH s AS ({' UNION ALL '.join(_spans(i, p) for i, p in enumerate((r'licen[cs]ed?\s+[a-z]+', r'[a-z0-9.]+@[a-z0-9]+\.[a-z]+', r'all\s+rights\s+reserved')))}) SELECT id, pattern, CAST(start AS INTEGER) AS start, CAST(start + size AS INTEGER) AS \"end\" FROM s"

ORACLE_SQL["clean_signatures"] = f"""WITH {BLOCKS}, {SIGNATURES}, l AS (SELECT file_id, list_sort(list(norm))[1:20] AS s FROM signatures GROUP BY 1)
    SELECT d.doc_id AS file_id, CAST(coalesce(len(s), 0) AS INTEGER) AS signatures, md5(coalesce(array_to_string(s, '|'), '')) AS signatures_md5 FROM documents d LEFT JOIN l ON l.file_id = d.doc_id"""
