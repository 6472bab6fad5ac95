"""Schemas of the tables, and their lists of values."""

from __future__ import annotations

FILES = (
    "file_id long, file_name string, file_type string, checksum string, source_path string, doc_scope string, language string, "
    "status string, fail_reason string, upload_user string, file_size long, doc_version int, retry_count int, injection_flag boolean, "
    "quality_score decimal(5,2), created_at timestamp, updated_at timestamp"
)
CHUNKS = (
    "chunk_id long, file_id long, chunk_index int, chunk_text string, chunk_text_norm string, token_count int, page_number int, "
    "sheet_name string, section_title string, char_start int, char_end int"
)
VECTORS = "chunk_id long, embedding array<float>, model_name string"
TABLES = "file_id long, page_number int, table_index int, sheet_name string, table_text string, table_data array<array<string>>"
FIGURES = "file_id long, page_number int, figure_index int, caption string, storage_path string"
METRICS = "metric_id long, file_id long, step string, duration_ms int, ok boolean, detail string, created_at timestamp"
FINDINGS = "finding_id long, file_id long, chunk_id long, finding string, detail string, resolved boolean"
GOLDEN = (
    "id string, question string, ideal_answer string, category string, difficulty int, "
    "gold_evidence array<struct<file_name:string,page:int,sheet:string,quote:string>>, doc_scope string, answerable boolean, created_by string, notes string"
)
PARSED = (
    "file_id long, pages array<struct<page_no:int,text_blocks:array<string>>>, "
    "sections array<struct<title:string,level:int,page_start:int>>, "
    "tables array<struct<index:int,data:array<array<string>>,flattened_text:string,page_no:int,sheet_name:string>>, "
    "figures array<struct<index:int,page_no:int,caption:string>>, language string, parse_warnings array<string>"
)

FILE_TYPES = ("pdf", "docx", "xlsx", "txt")
STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "RETRY", "REPROCESS")
TERMINAL = ("COMPLETED", "FAILED")
STEPS = ("intake", "parse", "clean", "chunk", "embed", "store", "injection_scan")
OUTCOMES = ("CREATED", "VERSIONED", "SKIPPED", "FAILED", "REJECTED")
CATEGORIES = ("single_fact", "multi_hop", "synthesis", "table_based", "citation_sensitive", "unanswerable")
CHUNK_FINDINGS = ("empty_chunk", "too_short", "too_long", "duplicate_chunk")
