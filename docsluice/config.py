"""Settings in layers: defaults, then the environment, then a config table. Lists are replaced whole."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame

PREFIX = "DOCSLUICE_"

#: Defaults by group.
DEFAULTS: dict[str, dict] = {
    "chunking": {"strategy": "section", "max_tokens": 512, "overlap_tokens": 64, "min_tokens": 30},
    "embedding": {"model": "BAAI/bge-m3", "dim": 1024, "batch_size": 32},
    "ingestion": {"allowed_types": ["pdf", "docx", "xlsx", "txt"], "max_file_mb": 100, "parse_timeout_sec": 300, "stuck_processing_minutes": 30, "retry_limit": 3},
    "quality": {
        "weights": {"parse": 0.35, "clean": 0.20, "chunk": 0.25, "embed": 0.20},
        "parse": {"hard_fail_coverage": 0.50, "hard_fail_garbage": 0.20, "soft_flag_coverage": 0.85},
        "clean": {"hard_fail_retention": 0.60, "soft_flag_retention_low": 0.80, "soft_flag_retention_high": 0.999},
        "chunk": {"soft_flag_truncated_ratio": 0.30},
        "embed": {"anomaly_cosine_high": 0.98},
        "ocr_fallback": {"enabled": True, "trigger_coverage_below": 0.50, "max_retry": 1},
    },
    "injection": {"enabled": True, "hidden_unicode_min_count": 1, "base64_min_run": 40, "homoglyph_min_count": 2},
    "retrieval": {
        "default_top_k": 10, "max_top_k": 20, "vector_ef_search": 80, "hybrid_fusion": "rrf", "hybrid_rrf_k": 60, "hybrid_dense_weight": 1.0,
        "hybrid_sparse_weight": 1.0, "hybrid_sparse_variant": "simple", "rerank_backend": "passthrough", "rerank_timeout_sec": 5.0, "rerank_retries": 1,
        "context_token_budget": 4000, "context_token_safety_margin": 1.1, "context_low_quality_threshold": 70.0,
    },
    "agent": {"max_iterations": 4, "max_tokens": 16000, "timeout_sec": 60, "validation_coverage_threshold": 0.70, "confidence_high_coverage_threshold": 0.90, "max_question_chars": 2000},
}


def merged(*layers: tuple[str, Mapping]) -> tuple[dict, dict[str, str]]:
    """Later layers win leaf by leaf. Returns the tree, and for each leaf's dotted path the layer it is from."""
    tree: dict = {}
    source: dict[str, str] = {}

    def put(into: dict, layer: Mapping, name: str, at: str) -> None:
        for key, value in layer.items():
            path = f"{at}{key}"
            if isinstance(value, Mapping):
                if not isinstance(into.get(key), dict):
                    source.pop(path, None)
                    into[key] = {}
                put(into[key], value, name, f"{path}.")
            else:
                for old in [p for p in source if p.startswith(f"{path}.")]:
                    del source[old]
                into[key], source[path] = value, name

    for name, layer in layers:
        put(tree, layer, name, "")
    return tree, source


def from_environment(env: Mapping[str, str] | None = None) -> dict:
    """DOCSLUICE_<GROUP>_<FIELD>, values as JSON or else as they stand; only known groups."""
    out: dict = {}
    for name, raw in (os.environ if env is None else env).items():
        group, _, key = name.removeprefix(PREFIX).lower().partition("_")
        if name.startswith(PREFIX) and key and group in DEFAULTS:
            try:
                value = json.loads(raw)
            except ValueError:
                value = raw
            out.setdefault(group, {})[key] = value
    return out


def from_table(rows: DataFrame) -> dict:
    """A table of config_key and config_value (JSON); a handful of rows."""
    return {r["config_key"]: json.loads(r["config_value"]) for r in rows.select("config_key", "config_value").where("config_value is not null").collect()}


def load(table: DataFrame | None = None, env: Mapping[str, str] | None = None) -> tuple[dict, dict[str, str]]:
    return merged(("default", DEFAULTS), ("env", from_environment(env)), ("db", from_table(table) if table is not None else {}))


SECRET = ("password", "secret", "token_key", "api_key", "dsn")


def seed_sql(tree: Mapping[str, Mapping], on_conflict: str = "do-nothing") -> str:
    """INSERT statements for the config table in the order of keys; names that look secret are refused.
    `merge` lets values that exist win over those of the seed, and then fills in what nested settings lack."""
    if on_conflict not in ("do-nothing", "merge"):
        raise ValueError(f"no such mode: {on_conflict}")

    def names(x, at=""):
        for k, v in x.items():
            yield f"{at}{k}"
            if isinstance(v, Mapping):
                yield from names(v, f"{at}{k}.")

    if bad := [n for n in names(tree) if any(s in n.lower() for s in SECRET)]:
        raise ValueError(f"not for a seed: {', '.join(sorted(bad))}")
    tail = "DO NOTHING" if on_conflict == "do-nothing" else "DO UPDATE SET config_value = EXCLUDED.config_value || app_config.config_value"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "".join(f"INSERT INTO app_config (config_key, config_value) VALUES ({quote(k)}, {quote(json.dumps(tree[k], sort_keys=True, ensure_ascii=False))})\nON CONFLICT (config_key) {tail};\n" for k in sorted(tree)) + (backfill_sql(tree) if on_conflict == "merge" else "")


def backfill_sql(tree: Mapping[str, Mapping]) -> str:
    """An UPDATE for each nested leaf, which only writes where its key is missing: a merge is by whole first-level
    values and leaves such gaps. Settings deeper than a parent that is missing too are written from the outside in."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def gaps(at: tuple[str, ...], value):
        yield at, {} if isinstance(value, Mapping) else value
        if isinstance(value, Mapping):
            for k in sorted(value):
                yield from gaps((*at, k), value[k])

    out = []
    for group in sorted(tree):
        for first in sorted(k for k, v in tree[group].items() if isinstance(v, Mapping)):
            for at, value in gaps((first,), tree[group][first]):
                if len(at) < 2:
                    continue  # the merge has put it there
                place, parent = "{" + ",".join(at) + "}", "{" + ",".join(at[:-1]) + "}"
                new = f"jsonb_set(config_value, {quote(place)}, {quote(json.dumps(value, sort_keys=True, ensure_ascii=False))}::jsonb)"
                out.append(f"UPDATE app_config SET config_value = {new}\nWHERE config_key = {quote(group)} AND NOT jsonb_exists(config_value #> {quote(parent)}, {quote(at[-1])});\n")
    return "".join(out)
