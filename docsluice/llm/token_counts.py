"""Token counts of sections: whole documents are encoded once, token spans are joined to sections."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsluice.llm.common import apart, held, named, texts


class TokenLengths:
    """Byte lengths of a text's tokens, under a byte-level vocabulary given as ranks. Such tokens' bytes are the
    text's bytes, so lengths are spans."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.size = np.zeros(max(merges.values()) + 1, np.int64)
        for token, i in merges.items():
            self.size[i] = len(token)

    def of(self, text: str) -> np.ndarray:
        return self.size[np.asarray(self.encode(text), np.int64)]


def allocate(token_ends: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. token_ends: where each token ends; edges: where each section ends, the last
    at the text's end. Spans are half-open and cover the text, so the join is a merge of two sorted lists.

    A token that crosses an edge goes, by `rule`: `start`, to the section of its first byte; `end`, to that
    of its last byte; `most`, to the one that has most of it, the earlier of equals; `split`, to each
    in proportion to its bytes (counts are then fractions)."""
    starts = np.concatenate(([0], token_ends[:-1])).astype(np.int64) if len(token_ends) else np.zeros(0, np.int64)
    first, last = np.searchsorted(edges, starts, "right"), np.searchsorted(edges, token_ends, "left")
    n = len(edges)
    if rule == "start":
        return np.bincount(first, minlength=n)
    if rule == "end":
        return np.bincount(last, minlength=n)
    crossing = np.flatnonzero(first != last)
    inside = np.bincount(np.delete(first, crossing), minlength=n).astype(np.float64 if rule == "split" else np.int64)
    for t in crossing.tolist():
        cuts = np.concatenate(([starts[t]], edges[first[t] : last[t]], [token_ends[t]]))
        share = np.diff(cuts)
        if rule == "split":
            inside[first[t] : last[t] + 1] += share / share.sum()
        elif rule == "most":
            inside[first[t] + int(np.argmax(share))] += 1
        else:
            raise ValueError(f"no such rule: {rule}")
    return inside


def line_edges(data: bytes) -> np.ndarray:
    """Sections are lines, each with the line feed that ends it."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def count_tokens_by_line(docs: DataFrame, ranks_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", rule: str = "start") -> DataFrame:
    """One row per document and line: id, section (from 0), start_char, end_char (half-open), n_tokens
    (double under the rule `split`, else long), doc_tokens (of the whole document).

    A document is encoded once, whole; crossing tokens are allocated by `rule` (see `allocate`). So the
    counts of a document's sections add up to doc_tokens. A null or empty text has one section of no
    characters and no tokens; repeated rows give repeated rows. A very long text is encoded whole, a few numbers a
    token; an id whose name the result has already gets `_id` behind it. One pass, no shuffle.
    """
    with open(ranks_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kind, of = ("double", pa.float64()) if rule == "split" else ("long", pa.int64())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        lengths = held(("token lengths", hashlib.sha256(ranks.value).hexdigest(), pattern), lambda: TokenLengths(ranks.value, pattern))
        for batch in batches:
            ids, got = [], [[] for _ in range(5)]
            for row, text in enumerate(texts(batch, "text")):
                data = text.encode()
                edges, sizes = line_edges(data), lengths.of(text)
                counts = allocate(np.cumsum(sizes, dtype=np.int64), edges, rule)
                chars = edges if len(data) == len(text) else np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[edges - 1]
                ids.append(np.full(len(edges), row))
                for x, y in zip(got, (np.arange(len(edges)), np.concatenate(([0], chars[:-1])), chars, counts, np.full(len(edges), len(sizes))), strict=True):
                    x.append(y)
            if ids:
                columns = [np.concatenate(x) for x in got]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.concatenate(ids))), *(pa.array(x, of if i == 3 else pa.int64()) for i, x in enumerate(columns))], names=["id", "section", "start_char", "end_char", "n_tokens", "doc_tokens"])

    schema = f"id {id_type}, section long, start_char long, end_char long, n_tokens {kind}, doc_tokens long"
    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", apart(id_col, "section", "start_char", "end_char", "n_tokens", "doc_tokens"))
