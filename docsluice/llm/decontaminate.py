"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of m words may be found with up to k edits (words inserted, left out or replaced). Cut into
k + 1 pieces, at least one piece is then found unchanged. Hits of pieces are looked up exactly, and the
text around each hit is verified with Myers' bit-parallel distance, words being the symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import apart, named, texts

#: Edits allowed, as a share of an item's words.
EDIT_SHARE = 0.2
#: Items of a pass may have so many bytes; more items are looked for in several passes.
INDEX_BYTES = 16 << 20
#: ASCII characters that do not count as parts of words.
_SEPARATE = bytes(x if chr(x).isalnum() or x >= 128 else 0x20 for x in range(256))


def item_words(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them."""
    return text.lower().encode().translate(_SEPARATE).split()


def approximate_ends(pattern: list[int], text: list[int], k: int) -> list[tuple[int, int]]:
    """Myers: (end, distance) of each place where some part of `text` ending there is within k edits."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, distance, out = full, 0, m, []
    for end, x in enumerate(text):
        equal = masks.get(x, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(horizontal | up) & full, up & horizontal
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
        if distance <= k:
            out.append((end + 1, distance))
    return out


@dataclass
class ItemIndex:
    """Items as word numbers, and the pieces by length: sorted hashes, and each piece's item and offset."""

    items: list[tuple[object, list[int], int]]
    vocabulary: dict[bytes, int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    BITS = 20

    @classmethod
    def build(cls, rows: list[tuple[object, str]], edit_share: float) -> ItemIndex:
        vocabulary: dict[bytes, int] = {}
        items, found = [], {}
        for key, text in rows:
            words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in item_words(text or "")]
            if not words:
                continue
            k = int(edit_share * len(words))
            items.append((key, words, k))
            edges = [len(words) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(edges, edges[1:]):
                found.setdefault(b - a, []).append((words[a:b], len(items) - 1, a))
        pieces = {}
        for n, these in found.items():
            h = cls._hash(np.array([x[0] for x in these], np.uint64).T, n)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << cls.BITS, bool)
            seen[(h >> np.uint64(64 - cls.BITS)).astype(np.int64)] = True
            pieces[n] = h[order], np.array([x[1] for x in these])[order], np.array([x[2] for x in these])[order], seen
        return cls(items, vocabulary, pieces)

    @staticmethod
    def _hash(columns, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(columns[0].shape, n, np.uint64)
            for x in columns:
                h = (h ^ x) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            return h

    def find(self, words: list[bytes]) -> list[tuple[object, int, int, int]]:
        """(item, distance, end word, item's words) for each item found: its best place, the first of equals."""
        number = self.vocabulary.get
        codes = np.fromiter((number(w, 0) for w in words), np.uint64, len(words))
        near: dict[int, list[int]] = {}
        for n, (hashes, item, offset, seen) in self.pieces.items():
            count = len(codes) - n + 1
            if count <= 0:
                continue
            h = self._hash([codes[i : i + count] for i in range(n)], n)
            at = np.flatnonzero(seen[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
            for p in at[np.isin(h[at], hashes)].tolist():
                for j in range(np.searchsorted(hashes, h[p]), np.searchsorted(hashes, h[p], "right")):
                    near.setdefault(int(item[j]), []).append(p - int(offset[j]))
        out = []
        for i, starts in near.items():
            key, pattern, k = self.items[i]
            best, windows = None, []
            for start in sorted(set(starts)):
                a, b = max(0, start - k), min(len(words), start + len(pattern) + k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                for end, distance in approximate_ends(pattern, codes[a:b].tolist(), k):
                    if best is None or distance < best[0]:
                        best = distance, a + end
            if best:
                out.append((key, *best, len(pattern)))
        return out


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, edit_share: float, index_bytes: int) -> Iterator[ItemIndex]:
    """An index for each pass over the documents, made when it is asked for: the driver has the items of one pass.

    Rows equal in item and text are one item, whose key is the item and how often it comes, so that repeated rows
    don't fill a pass."""
    items = benchmark.select(named(item_col).alias("item"), named(text_col).alias("text")).where("text is not null").groupBy("item", "text").agg(F.count("*").alias("times"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // index_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(passes))
    for i in range(passes):
        yield ItemIndex.build([((r["item"], r["times"]), r["text"]) for r in items.where(part == i).collect()], edit_share)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_share: float = EDIT_SHARE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each document and test item found in it: id, item, distance (edits in words at its best
    place), item_words, end_word (the place's end in the document's words). Documents without an item give
    no row; rows repeated in the input give repeated rows.

    Whole texts are scanned, case and ASCII punctuation aside. Null or empty texts and items match
    nothing; an item of fewer words than 1 / edit_share must occur as it is. Items equal in words are all
    reported, also where they stand at one place. The index of a pass is bounded by `index_bytes` of item text; more items
    take more passes. Names may have dots; a document's or an item's id whose name the result has already gets `_id` behind it.
    """
    found = None
    ours = ("distance", "item_words", "end_word")
    id_out = apart(id_col, *ours)
    item_out = apart(item_col, id_out, *ours)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    for made in _indexes(benchmark, item_col, item_text_col, edit_share, index_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                out = [(doc, item, *hit) for doc, text in zip(batch.column("id").to_pylist(), texts(batch, "text"), strict=True) for (item, times), *hit in index.find(item_words(text)) for _ in range(times)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [batch.schema.field("id").type, None, pa.int64(), pa.int64(), pa.int64()]
                if out:
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("id", "item", "distance", "end_word", "item_words"), columns, kinds, strict=True)})

        one = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {id_type}, item {item_type}, distance long, end_word long, item_words long")
        found = one if found is None else found.unionByName(one)
    return found.select(F.col("id").alias(id_out), F.col("item").alias(item_out), "distance", "item_words", "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_share: float = EDIT_SHARE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows whose text holds no test item, with all their columns, of any names; one pass for each
    `index_bytes` of items. Rows with null or empty texts stay, null or empty items match nothing; rows repeated
    in the input are judged alike, and a very long text is scanned to its end. No items: all rows stay."""
    columns = docs.columns
    text_at = columns.index(text_col)
    docs = docs.toDF(*(f"c{i}" for i in range(len(columns))))  # names may have dots
    for made in _indexes(benchmark, item_col, item_text_col, edit_share, index_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches, sent=sent):
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.find(item_words(t)) for t in texts(batch, f"c{text_at}")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*columns)
