"""Blocks of documents as numbered words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.blocks import BLOCK_BYTES, mix, pack_ints, unpack_ints, write_blocks
from docsluice.llm.common import Scratch, named

SHINGLE = 5
SCHEMA = "doc_ids array<long>, flags binary, ends binary, words binary, tokens binary, sizes array<long>, prints array<long>, more_prints array<long>"


#: White space between words, by byte.
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def all_words(texts: list[str], with_end: bool) -> tuple[pa.BinaryArray, np.ndarray]:
    """All texts' words, between ASCII white space (space, tab to carriage return), A-Z in lower case, each text's closed by an
    empty one if asked for, and where each text's end. They are found in the bytes of all texts at once: none is an object."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]).lower(), np.uint8)  # a space after each text
    close = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    del parts
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.append(0, edge)  # the last byte is a space, so each word that begins has an end
    sizes, ends = np.diff(edge)[::2], np.searchsorted(edge[::2], close)
    if with_end:
        sizes = np.insert(sizes, ends, 0)
        ends = ends + np.arange(1, len(ends) + 1)
    kept = data[inside]
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), ends.astype("<i8")


def byte_strings(array: pa.BinaryArray) -> list[bytes]:
    """As `to_pylist` of an array without nulls, which makes a scalar of each entry first."""
    _, offsets, data = array.buffers()
    if not len(array):
        return []
    at = np.frombuffer(offsets, np.int32, len(array) + 1, 4 * array.offset).tolist()
    whole = data.to_pybytes() if data else b""
    return [whole[a:b] for a, b in zip(at, at[1:])]


class TokenBlock:
    """A block: documents' ids and flags, where each one's words end, the distinct words' hashes, and the
    words as numbers of those."""

    def __init__(self, row: pa.Table):
        self.block = row["block"][0].as_py()
        self.doc_ids = row["doc_ids"][0].as_py()
        self.flags = np.frombuffer(row["flags"][0].as_py(), bool)
        self.ends = np.frombuffer(row["ends"][0].as_py(), "<i8")
        self.words = np.frombuffer(row["words"][0].as_py(), "<u8")
        self.tokens = unpack_ints(memoryview(row["tokens"][0].as_buffer()))[0].astype(np.int32)

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1])).astype(np.int64)


def shingle_sets(words: np.ndarray, tokens: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles as ascending hashes, and where each document's end. A document with
    fewer words than a shingle has its whole sequence as the only one, one without words has none."""
    h = words[tokens]
    n = max(len(h) - size + 1, 0)
    with np.errstate(over="ignore"):
        s = np.full(n, size, np.uint64)
        for i in range(size):
            s = (s ^ h[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(32)
    s = mix(s)
    out, sizes, a = [], [], 0
    for b in ends.tolist():
        if b - a >= size:
            one = np.unique(s[a : b - size + 1])
        elif b > a:
            one = np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), b - a)], np.uint64)
        else:
            one = np.zeros(0, np.uint64)
        out.append(one)
        sizes.append(len(one))
        a = b
    return (np.concatenate(out) if out else s[:0]), np.cumsum(sizes)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    with np.errstate(over="ignore"):
        return np.diff(total[np.concatenate(([0], ends)).astype(np.int64)])


def _encode(with_end: bool, with_sets: bool):
    def encode(held: dict, block: int) -> dict:
        said, ends = all_words(held["text"], with_end)
        coded = said.dictionary_encode()
        hashes = mix(np.fromiter(map(xxhash.xxh64_intdigest, byte_strings(coded.dictionary)), np.uint64, len(coded.dictionary)))
        every = coded.indices.to_numpy().astype("<i4")
        del said, coded
        # frequent words get small numbers, so that most of the upper byte planes are zero
        order = np.argsort(-np.bincount(every, minlength=len(hashes)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        every, hashes = rank[every], hashes[order]
        out = {"doc_ids": held["id"], "flags": np.array(held["flag"], bool).tobytes(), "ends": ends.tobytes(), "words": hashes.astype("<u8").tobytes(), "tokens": pack_ints(every.astype(np.uint64))}
        if with_sets:
            sets, set_ends = shingle_sets(hashes, every, ends)
            out |= {"sizes": np.diff(set_ends, prepend=0).tolist(), "prints": _sums(sets, set_ends).view(np.int64).tolist(), "more_prints": _sums(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), set_ends).view(np.int64).tolist()}
        return out

    return encode


def write_token_blocks(docs: DataFrame, scratch: Scratch, name: str, flag: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", with_end: bool = False, with_sets: bool = False, block_bytes: int | None = None) -> DataFrame:
    """A null text has no words. `flag` marks documents; `with_end` closes each with an empty word;
    `with_sets` adds the sizes and 128-bit sums of the shingle sets."""
    rows = docs.select(named(id_col).try_cast("long").alias("id"), named(text_col).alias("text"), (F.lit(True) if flag is None else flag).alias("flag"))
    return write_blocks(rows, ["id", "text", "flag"], _encode(with_end, with_sets), SCHEMA, scratch, name, block_bytes or BLOCK_BYTES)
