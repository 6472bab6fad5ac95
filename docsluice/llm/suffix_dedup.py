"""Suffix-array dedup of byte strings that occur more than once in a corpus.

Within a text, suffixes are sorted and neighbours' common prefixes measured. In suffix order the nearest
entries before and after an entry whose text position is smaller give its longest previous factor: the
longest match that starts earlier. Where that is at least `least` bytes, the `least` bytes from there on are
a later copy. With positions counted backwards the same gives the longest match that starts later, and the
longer of both tells what occurs anywhere else.

Over a corpus no task can hold all suffixes, so windows of `least` bytes are first dealt out by content. The
anchor of a window is its smallest 64-byte gram (by hash, the leftmost of equals); equal windows have equal
anchors at equal offsets. Only anchors that occur twice can matter. For these the stretch of text whose
windows share the anchor goes to the anchor's bucket, by way of the group that its block belongs to, where
equal stretches become one. In the bucket the stretches that differ are put one after the other, in the order
of the documents they first occur in, and the previous factors of this text (cut off at the length asked for)
settle which windows occur again or earlier. Where so many stretches of one anchor differ that their suffix
order would not fit (over 1 MB of them), their windows are grouped by hashes and confirmed by bytes instead.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from docsluice.llm.blocks import ANSWER, DOWN, SENT, UP, Keyed, bucket_bits, by_block, mix, on_blocks, pack_ints, payloads_by, sorted_order, summed, table_of, unpack_ints, write_blocks
from docsluice.llm.common import Scratch, named, text_bytes

GRAM = 64
#: Anchors with more occurrences are split further, by the place of the window around them.
HOT = 20_000
HOT_STEP = 32
#: Bytes of text that anchors are found in at a time, and of stretches that one suffix order is made of.
PIECE = 1 << 19
_PLACE = np.uint64((1 << 31) - 1)
_SALT = np.uint64(0x8EBC6AF09C88C6E3)
#: No byte of UTF-8.
_BREAK = b"\xff"
_LAST = (1 << 64) - 1


# -- one text ---------------------------------------------------------------------------------------


def prefix_ranks(data: np.ndarray, most: int, keep: bool = True) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 8, 16, ... bytes, up to at least `most` bytes or until all differ;
    past the end counts as before everything. Without `keep` only the last ranks are returned."""
    n = len(data)
    symbols = np.append(data.astype(np.uint64) + np.uint64(1), np.zeros(3, np.uint64))  # a zero byte and the end differ
    key = np.zeros(n, np.uint64)
    for i in range(4):  # with a place in the order, these fit into 64 bits
        key = key << np.uint64(9) | symbols[i : n + i]
    rank = _paired(_ranked(key), 4)
    out, length = [(8, rank)], 8
    while length < most and n and rank.max() < n:
        rank = _paired(rank, length)
        length *= 2
        out = [*out, (length, rank)] if keep else [(length, rank)]
    return out


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Each key's rank among the distinct ones, from 1."""
    order = sorted_order(keys)
    ascending = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.append(True, ascending[1:] != ascending[:-1])[: len(keys)])
    return rank


def _paired(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks by twice the length: by the rank here, then by the rank `step` on."""
    n = len(rank)
    pair = rank * (n + 1)
    pair[: max(n - step, 0)] += rank[step:]
    return _ranked(pair.view(np.uint64))


def suffix_array(data: bytes) -> np.ndarray:
    return np.argsort(prefix_ranks(np.frombuffer(data, np.uint8), max(len(data), 8))[-1][1], kind="stable")


def neighbours_common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, data: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (at most about `most`), by halving steps."""
    n, out = len(data), np.zeros(len(a), np.int64)
    todo = np.ones(len(a), bool)
    while todo.any():  # the longest step may fit more than once
        length, rank = levels[-1]
        x, y = a + out, b + out
        todo &= (x < n) & (y < n) & (out < most)
        todo[todo] = (rank[x[todo]] == rank[y[todo]]) & (x[todo] != y[todo])
        out[todo] += length
    for length, rank in reversed(levels):
        x, y = a + out, b + out
        ok = (x + length <= n) & (y + length <= n)
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        out[ok] += length
    for _ in range(8):
        x, y = a + out, b + out
        ok = (x < n) & (y < n)
        ok[ok] = data[x[ok]] == data[y[ok]]
        out[ok] += 1
    return np.minimum(out, n - np.maximum(a, b))


def previous_factors(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each entry in suffix order, the longest match with an entry at a smaller place: what it shares with the
    previous or with the next smaller place. common: what each entry shares with the one before it, first 0.

    All entries look at once: one whose neighbour has a larger place goes on to where that neighbour looks."""
    out = np.zeros(len(places), np.int64)
    for back in (False, True):
        at_place, shared = (places[::-1], np.append(common[1:], 0)[::-1].copy()) if back else (places, common.copy())
        look, found = np.arange(len(places)) - 1, np.zeros(len(places), np.int64)
        open_ = np.flatnonzero(shared > 0)
        while len(open_):
            there = look[open_]
            smaller = at_place[there] < at_place[open_]
            found[open_[smaller]] = shared[open_[smaller]]
            open_, there = open_[~smaller], there[~smaller]
            left = np.minimum(shared[open_], shared[there])
            look[open_], shared[open_] = look[there], left
            open_ = open_[left > 0]
        out = np.maximum(out, found[::-1] if back else found)
    return out


def longest_previous_factors(text: bytes) -> np.ndarray:
    """For each byte, the longest match from there with a string that starts earlier in the text."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    levels = prefix_ranks(data, max(n, 8))
    order = np.argsort(levels[-1][1], kind="stable")
    out = np.zeros(n, np.int64)
    if n > 1:
        out[order] = previous_factors(order, np.append(0, neighbours_common(levels, order[:-1], order[1:], data, n)))
    return out


def _ranks_at(data: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Ranks of all suffixes by their first bytes, so many as each of `lengths` (ascending, 8 or more) says."""
    length, rank = prefix_ranks(data, 8, keep=False)[-1]
    out = []
    for most in lengths:
        while length < most:  # the last step may overlap what is compared already
            step = min(length, most - length)
            rank = _paired(rank, step)
            length += step
        out.append(rank)
    return out


def factors_at(data: np.ndarray, starts: np.ndarray, room: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors, and longest factors anywhere else, among `starts` (ascending) alone and rounded
    down to one of `lengths` (ascending) or 0. room: a factor at a start has so many bytes at most."""
    ranks = _ranks_at(data, lengths)
    order = sorted_order(ranks[-1][starts].view(np.uint64))
    places = starts[order].astype(np.int64)
    common = np.zeros(len(starts), np.int64)
    for length, rank in zip(lengths, ranks, strict=True):
        fits, r = room[order] >= length, rank[places]
        common[1:][(r[1:] == r[:-1]) & fits[1:] & fits[:-1]] = length
    earlier, other = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    earlier[order] = previous_factors(places, common)
    other[order] = np.maximum(earlier[order], previous_factors(-places, common))
    return earlier, other


def window_hashes(data: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """A 64-bit hash of the `least` bytes from each start on, put together from powers of two."""
    out, at, h, length = np.zeros(len(starts), np.uint64), starts.copy(), data.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while True:
            if least & length:
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at])
                at += length
            if 2 * length > least:
                return out
            h = h[: len(h) - length] * np.uint64(0xD6E8FEB86659FD93) + h[length:]
            h ^= h >> np.uint64(31)
            length *= 2


def factors_in_large(texts: list[bytes], windows: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """`factors_at` for the first starts, so many as `windows` says, of texts too many for one suffix order: for each
    length, equal windows are found by 64-bit hashes, some texts at a time, so that a window costs a few bytes
    and not its text's ranks. Their bytes are compared; windows whose hashes meet by chance are told apart."""
    sizes = np.array([len(t) for t in texts])
    room = np.concatenate([np.arange(n, n - w, -1) for n, w in zip(sizes.tolist(), windows.tolist(), strict=True)])
    earlier, other = np.zeros(len(room), np.int64), np.zeros(len(room), np.int64)
    for length in lengths:
        counts = np.clip(sizes - length + 1, 0, windows)
        hashes = []
        for a in range(0, len(texts), 256):
            data = np.frombuffer(b"".join(texts[a : a + 256]), np.uint8)
            hashes.append(window_hashes(data, _places(sizes[a : a + 256], counts[a : a + 256]), length))
        place = _confirmed(b"".join(texts), _places(sizes, counts), np.unique(np.concatenate(hashes), return_inverse=True)[1], length)
        _, first, place, count = np.unique(place, return_index=True, return_inverse=True, return_counts=True)
        fits = np.flatnonzero(room >= length)
        earlier[fits[first[place] != np.arange(len(place))]] = length
        other[fits[count[place] > 1]] = length
    return earlier, other


def _places(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first places, so many as `counts` says, of texts of these sizes that stand one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(before - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _confirmed(raw: bytes, at: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """The group of the window at each place, with groups of windows that differ split. Windows that follow each other
    and have the first ones of their groups at one distance are compared in one piece."""
    if not len(at):
        return place
    _, first, group = np.unique(place, return_index=True, return_inverse=True)
    back = at - at[first[group]]
    new = np.flatnonzero((np.diff(back, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    mixed = set()
    for i, j in zip(new.tolist(), np.append(new[1:], len(at)).tolist()):
        a, b, d = int(at[i]), int(at[j - 1]) + least, int(back[i])
        if d and raw[a:b] != raw[a - d : b - d]:
            mixed.update(group[i:j].tolist())
    if mixed:
        kinds: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(np.isin(group, list(mixed))).tolist():
            x = int(at[i])
            group[i] = kinds.setdefault((int(group[i]), raw[x : x + least]), len(first) + len(kinds))
    return group


# -- blocks of a corpus -------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each place on."""
    with np.errstate(over="ignore"):
        h, length = data.astype(np.uint64), 1
        while length < GRAM:
            h = h[: len(h) - length] * np.uint64(0x9E3779B97F4A7C15 + 2 * length) + h[length:]
            h ^= h >> np.uint64(31)
            length *= 2
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` values on end, by running minima within pieces of that width."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[:n] = values
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`runs_of_anchors`, some documents at a time: the arrays are many times the text."""
    cuts, last = [0], 0
    for i, b in enumerate(ends.tolist(), 1):
        if b - last >= PIECE or i == len(ends):
            cuts.append(i)
            last = b
    out = [runs_of_anchors(data[:0], ends[:0], least)]
    for i, j in zip(cuts, cuts[1:]):
        a = int(ends[i - 1]) if i else 0
        h, *places = runs_of_anchors(data[a : int(ends[j - 1])], ends[i:j] - a, least)
        out.append((h, *(x + a for x in places)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs_of_anchors(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash, its place, the run's first and last window start."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    least_at = sliding_min((h & ~_PLACE) | place, least - GRAM + 1)
    at = (least_at & _PLACE).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    long = ends - starts >= least
    ok = np.zeros(len(at) + 1, np.int8)
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, np.minimum(ends[long] - least + 1, len(at)), -1)
    ok = np.cumsum(ok[:-1]) > 0
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    new[starts[long]] = True
    first = np.flatnonzero(new)
    last_ok = np.append(np.flatnonzero(ok[:-1] & ~ok[1:]), [len(ok) - 1] if ok[-1] else [])
    following = np.append(first[1:], len(ok))
    # a run ends before the next one or at the last good start of its document
    last = np.minimum(following - 1, last_ok[np.searchsorted(last_ok, first)]) if len(first) else first
    # anchors are smallest hashes: mixed again, their keys fill all buckets alike
    return mix(h[at[first]] ^ _SALT), at[first], first, last.astype(np.int64)


def _encode(held: dict, block: int) -> dict:
    data = [t.encode() for t in held["text"]]
    return {"doc_ids": held["id"], "rest": held["rest"], "ends": np.cumsum([len(x) for x in data], dtype="<i8").tobytes(), "data": b"".join(data)}


def _read_block(row: pa.Table) -> tuple[int, list, np.ndarray, np.ndarray]:
    return row["block"][0].as_py(), row["doc_ids"][0].as_py(), np.frombuffer(row["ends"][0].as_buffer(), "<i8"), np.frombuffer(row["data"][0].as_buffer() or b"", np.uint8)


def _places_in_order(ids: list, ends: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The order of documents: by id, nulls last, then by a hash of the text. Two columns to sort by for each."""
    starts = np.concatenate(([0], ends[:-1])).tolist()
    by_id = np.array([_LAST if i is None else i + (1 << 63) for i in ids], np.uint64)
    return by_id, np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)], np.uint64)


class _Entries:
    """Distinct stretches of text, each with its anchor's key, the anchor's offset, the number of its windows (those
    of the anchor are the first; what follows only fills up the last ones), the number of places where it is, and (id, text hash, offset in the document) of the first of those."""

    COLUMNS = 8

    def __init__(self):
        self.of: dict[tuple[int, int, bytes, int], list] = {}

    def add(self, key: int, offset: int, text: bytes, windows: int, count: int, first: tuple, where: object) -> None:
        entry = self.of.setdefault((key, offset, text, windows), [0, first, []])
        entry[0] += count
        entry[1] = min(entry[1], first)
        entry[2].append(where)

    def packed(self, names: list[tuple[int, int, bytes, int]], *more: np.ndarray) -> bytes:
        first = [self.of[n][1] for n in names]
        columns = [[n[0] for n in names], [n[1] for n in names], [len(n[2]) for n in names], [n[3] for n in names], [self.of[n][0] for n in names], *([f[i] for f in first] for i in range(3))]
        return b"".join([*(pack_ints(np.array(c, np.uint64)) for c in columns), *map(pack_ints, more), *(n[2] for n in names)])

    @classmethod
    def unpacked(cls, data: memoryview, more: int = 0) -> tuple[list[tuple], list[np.ndarray]]:
        """(key, offset, text, windows, count, first) of each entry, and `more` columns."""
        columns = []
        for _ in range(cls.COLUMNS + more):
            column, data = unpack_ints(data)
            columns.append(column)
        key, offset, length, windows, count, *first = (c.tolist() for c in columns[: cls.COLUMNS])
        text, out, p = bytes(data), [], 0
        for k, o, n, w, c, f in zip(key, offset, length, windows, count, zip(*first, strict=True), strict=True):
            out.append((k, o, text[p : p + n], w, c, f))
            p += n
        return out, columns[cls.COLUMNS :]


def _stretches(row: pa.Table, found: tuple, totals: np.ndarray, keyed: Keyed, lengths: list[int], hot_from: int, in_order: bool) -> list[tuple[int, int, bytes]]:
    """Rows of SENT with the stretches of text around anchors that occur again; equal stretches of a block
    go once, with all places where they are."""
    block, ids, ends, data = _read_block(row)
    h, at, first, last = (x[totals >= 2] for x in found)
    hot = totals[totals >= 2] >= hot_from
    raw = data.tobytes()
    key, offset, a, b = h, at - first, first, last
    if hot.any():
        parts = [(key[~hot], offset[~hot], a[~hot], b[~hot])]
        for k, f, x, y in zip(h[hot], at[hot], first[hot], last[hot], strict=True):
            s = np.arange(x, y + 1)
            kind = (f - s) // HOT_STEP
            edge = np.flatnonzero(np.diff(kind, prepend=kind[0] - 1))
            lows, highs = s[edge], np.append(s[edge[1:] - 1], y)
            parts.append((mix(k ^ mix(kind[edge].astype(np.uint64) + np.uint64(1))), f - lows, lows, highs))
        key, offset, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc = np.searchsorted(ends, a, "right")
    stop = np.minimum(b + lengths[-1], ends[doc]) if len(a) else b
    if in_order and len(a):
        by_id, by_text = _places_in_order(ids, ends, raw)
        firsts = list(zip(by_id[doc].tolist(), by_text[doc].tolist(), (a - np.concatenate(([0], ends[:-1]))[doc]).tolist(), strict=True))
    else:
        firsts = [(0, 0, 0)] * len(a)
    by_part: dict[int, _Entries] = {}
    shift = 64 - keyed.part_bits
    for k, o, x, y, w, f in zip(key.tolist(), offset.tolist(), a.tolist(), stop.tolist(), (b - a + 1).tolist(), firsts, strict=True):
        by_part.setdefault(k >> shift, _Entries()).add(k, o, raw[x:y], w, 1, f, (f, x))
    out = []
    for part, entries in by_part.items():
        places = [x for _, _, where in entries.of.values() for _, x in (sorted(where) if in_order else where)]
        out.append((part, block, entries.packed(list(entries.of), np.array(places, np.uint64))))
    return out


class _Settling:
    """What groups of blocks and buckets do with stretches."""

    def __init__(self, keyed: Keyed, lengths: list[int], keep_first: bool):
        self.keyed, self.lengths, self.keep_first = keyed, lengths, keep_first

    def _joined(self, rows: pa.Table) -> dict[int, tuple[_Entries, list]]:
        """By bucket of the part: the stretches of a group's blocks, and their names in order. An entry's places
        are (first, block, places in the block)."""
        inner: dict[int, _Entries] = {}
        shift, mask = 64 - self.keyed.bucket_bits, (1 << self.keyed.inner_bits) - 1
        for block, payload in payloads_by(rows, "block"):
            entries, (places,) = _Entries.unpacked(payload, 1)
            places, p = places.tolist(), 0
            for k, o, text, windows, count, first in entries:
                inner.setdefault(k >> shift & mask, _Entries()).add(k, o, text, windows, count, first, (first, block, places[p : p + count]))
                p += count
        return {i: (entries, list(entries.of)) for i, entries in sorted(inner.items())}

    def gather(self, rows: pa.Table) -> pa.Table:
        part, grp = rows["part"][0].as_py(), rows["grp"][0].as_py()
        return table_of(UP, [(part << self.keyed.inner_bits | i, part, grp, entries.packed(names)) for i, (entries, names) in self._joined(rows).items()])

    def settle(self, rows: pa.Table) -> pa.Table:
        """For a bucket's stretches: runs of window starts that occur again (earlier, with `keep_first`), in the
        answer to each group as columns: the entry's number there, the length's, whom it is for (0: all places,
        1: the first place only, 2: all others), and the run's first and last start within the stretch."""
        bucket, part = rows["bucket"][0].as_py(), rows["part"][0].as_py()
        groups: dict[int, dict[tuple[int, bytes, int], list]] = {}
        for grp, payload in payloads_by(rows, "grp"):
            for number, (k, o, text, windows, count, first) in enumerate(_Entries.unpacked(payload)[0]):
                groups.setdefault(k, {}).setdefault((o, text, windows), []).append((first, grp, number, count))
        out: dict[int, list[tuple]] = {}

        def tell(found: list, text: bytes, windows: int, runs_of: list[list]) -> None:
            many = sum(x[3] for x in found) > 1
            owner = min(found)
            for i, length in enumerate(self.lengths):
                whole = [(0, min(windows - 1, len(text) - length))] if len(text) >= length else []
                runs = runs_of[i]
                for entry in found:
                    _, grp, number, _ = entry
                    if self.keep_first and entry is owner:
                        told = [(1, runs), (2, whole)]
                    else:
                        told = [(0, whole if many else runs)]
                    out.setdefault(grp, []).extend((number, i, scope, a, b) for scope, them in told for a, b in them)

        several, none = [], [[] for _ in self.lengths]
        for texts_of in groups.values():
            if len(texts_of) > 1:
                several += texts_of.items()
            else:
                (((_, text, windows), found),) = texts_of.items()
                if sum(x[3] for x in found) > 1:
                    tell(found, text, windows, none)
        for some in _parts(several, PIECE):
            some.sort(key=lambda x: (min(x[1]), x[0]))  # documents in order
            texts, counts = [x[1] for x, _ in some], np.array([x[2] for x, _ in some])
            if sum(map(len, texts)) > 2 * PIECE:  # one anchor's
                earlier, other = factors_in_large(texts, counts, self.lengths)
            else:
                sizes = np.array([len(t) + 1 for t in texts])
                starts = _places(sizes, counts)
                earlier, other = factors_at(np.frombuffer(_BREAK.join(texts) + _BREAK, np.uint8), starts, np.repeat(np.cumsum(sizes) - 1, counts) - starts, self.lengths)
            factors, edges = earlier if self.keep_first else other, np.append(0, np.cumsum(counts))
            runs_of = zip(*(_runs(factors >= length, edges) for length in self.lengths), strict=True)
            for ((_, text, windows), found), runs in zip(some, runs_of, strict=True):
                tell(found, text, windows, runs)
        inner = struct.pack("<q", bucket & (1 << self.keyed.inner_bits) - 1)
        return table_of(DOWN, [(part, grp, inner + b"".join(pack_ints(np.array(c, np.uint64)) for c in zip(*told, strict=True))) for grp, told in out.items() if told])

    def deal(self, rows: pa.Table, answers: pa.Table) -> pa.Table:
        """For each block: runs of window starts, first and last, for each length in turn."""
        out: dict[int, list[tuple[list, list]]] = {}
        joined = self._joined(rows) if len(answers) else {}
        for payload in answers["payload"]:
            data = memoryview(payload.as_buffer())
            (inner,) = struct.unpack_from("<q", data)
            entries, names = joined[inner]
            columns, data = [], data[8:]
            for _ in range(5):
                column, data = unpack_ints(data)
                columns.append(column.tolist())
            for number, i, scope, a, b in zip(*columns, strict=True):
                where = entries.of[names[number]][2]
                first = min(where)[1:] if scope else None
                for _, block, places in where:
                    if scope == 1:
                        places = places[:1] if (block, places) == first else []
                    elif scope == 2 and (block, places) == first:
                        places = places[1:]
                    starts, ends = out.setdefault(block, [([], []) for _ in self.lengths])[i]
                    starts += [p + a for p in places]
                    ends += [p + b for p in places]
        return table_of(ANSWER, [(block, b"".join(pack_ints(np.array(x, np.uint64)) for pair in runs for x in pair)) for block, runs in out.items()])


def _runs(flags: np.ndarray, edges: np.ndarray) -> list[list[tuple[int, int]]]:
    """First and last place of each run of true ones, in each part between the edges (none empty)."""
    begin, end = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1]
    end[:-1] &= ~flags[1:]
    begin[edges[:-1]], end[edges[1:] - 1] = flags[edges[:-1]], flags[edges[1:] - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    part = np.searchsorted(edges, first, "right") - 1
    runs = list(zip((first - edges[part]).tolist(), (last - edges[part]).tolist(), strict=True))
    cuts = np.searchsorted(part, np.arange(len(edges))).tolist()
    return [runs[a:b] for a, b in zip(cuts, cuts[1:])]


def _parts(items: list, most: int) -> list[list]:
    """Stretches in lists of some MB. Those of one anchor come one after the other and stay together."""
    out, size, last = [], most, None
    for item in items:
        (offset, text, _), _ = item
        anchor = text[offset : offset + GRAM]
        if size >= most and anchor != last:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(text)
        last = anchor
    return out


def removed_spans(docs: DataFrame, result, schema: StructType, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None, lengths: list[int], keep_first: bool = True, whole_chars: bool = True, hot: int = HOT) -> DataFrame:
    """For each of `lengths` (ascending) find every byte covered by a string of so many bytes that starts elsewhere
    in the corpus (earlier, with `keep_first`), and return for each document what `result(id, carried, bytes,
    covered)` makes of it; None leaves it out. `carry`: other columns whose values (a list) are handed on;
    covered: a mask of the bytes for each length.

    The order of documents is by id, then by a hash of the text, and not that of the input's partitions; an id
    that is no integer counts as null, and nulls come last. A null text is empty. `whole_chars` leaves the bytes
    of characters that are only partly covered. Repeated rows are documents like others: a repeat of a row is
    a copy of it. Texts shorter than the length lose nothing; very long texts are cut into pieces while anchors
    are found, and have no limit but that a text (as any value) is in one task's memory. The least length is
    twice the gram of 64 bytes or more. Anchors that occur `hot` times are dealt to several buckets. Columns
    may have any names. The result is a table in `scratch`; all else is deleted.
    """
    least = lengths[0]
    if least < 2 * GRAM or sorted(lengths) != list(lengths):
        raise ValueError(f"lengths must ascend from {2 * GRAM} or more")
    keyed = Keyed(64, bucket_bits(text_bytes(docs, text_col)))
    settling = _Settling(keyed, list(lengths), keep_first)
    rest = F.struct(F.lit(True).alias("here"), *(c.alias(f"c{i}") for i, c in enumerate(carry or [])))
    rows = docs.select(named(id_col).try_cast("long").alias("id"), named(text_col).alias("text"), rest.alias("rest"))
    kinds = StructType([StructField("doc_ids", ArrayType(LongType())), StructField("rest", ArrayType(rows.schema["rest"].dataType)), StructField("ends", BinaryType()), StructField("data", BinaryType())])

    def count(row: pa.Table) -> pa.Table:
        block, _, ends, data = _read_block(row)
        kinds, sums, _ = summed(anchors(data, ends, least)[0])
        return table_of(SENT, keyed.send(block, kinds, sums))

    def stretches(row: pa.Table) -> pa.Table:
        _, _, ends, data = _read_block(row)
        found = anchors(data, ends, least)
        kinds, sums, place = summed(found[0])
        return table_of(SENT, _stretches(row, found, keyed.totals(kinds, sums, row["totals"])[place], keyed, settling.lengths, hot, keep_first))

    kind = arrow(schema)

    def cut(row: pa.Table) -> pa.Table:
        _, ids, ends, data = _read_block(row)
        depths = [np.zeros(len(data) + 1, np.int32) for _ in lengths]
        for payload in row["runs"][0].values or []:
            left = memoryview(payload.as_buffer())
            for depth, length in zip(depths, lengths, strict=True):
                first, left = unpack_ints(left)
                last, left = unpack_ints(left)
                np.add.at(depth, first.astype(np.int64), 1)
                np.add.at(depth, last.astype(np.int64) + length, -1)
        covered = [np.cumsum(depth[:-1], dtype=np.int32) > 0 for depth in depths]
        if whole_chars and len(data):
            lead = (data & 0xC0) != 0x80
            char = np.cumsum(lead, dtype=np.int32) - 1
            covered = [np.logical_and.reduceat(x, np.flatnonzero(lead))[char] if x.any() else x for x in covered]
        starts = np.concatenate(([0], ends[:-1]))
        made = (result(i, list(x.values())[1:], data[a:b], [c[a:b] for c in covered]) for i, x, a, b in zip(ids, row["rest"][0].as_py(), starts, ends, strict=True))
        return pa.Table.from_pylist([x for x in made if x is not None], schema=kind)

    with Scratch(docs.sparkSession) as tmp:
        blocks = write_blocks(rows, ["id", "text", "rest"], _encode, kinds, tmp, "texts")
        kept = blocks.select("block", "ends", "data", "doc_ids")
        totals = keyed.merge(on_blocks(kept, count, SENT), tmp, "anchors")
        sent = on_blocks(kept, stretches, SENT, totals=totals)
        runs = by_block(keyed.exchange(sent, settling.gather, settling.settle, settling.deal), tmp, "runs")
        return scratch.saved(on_blocks(blocks.select("block", "ends", "data", "doc_ids", "rest"), cut, schema, runs=runs), "repeats")


def arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def spans_of(gone: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1))


def repeat_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 400, note: int | None = None, keep_first: bool = False, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; see `removed_spans` for what each case
    gives. With `note`, a length below `least`, also n_repeated: the bytes covered by a string of so many bytes
    that occurs elsewhere, which are told and not removed. Other columns are not looked at."""

    def digest(doc, _, data, covered):
        gone = covered[-1]
        out = {"doc_id": doc, "n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": spans_of(gone), "kept_sha256": hashlib.sha256(data[~gone].tobytes()).hexdigest()}
        return out if note is None else out | {"n_repeated": int(covered[0].sum())}

    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * (note is not None))
    lengths = [least] if note is None else [note, least]
    return removed_spans(docs, digest, schema, scratch or Scratch(docs.sparkSession), id_col=id_col, text_col=text_col, lengths=lengths, keep_first=keep_first, whole_chars=False, hot=hot)


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", least: int = 400, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """The documents without later copies of strings of `least` bytes; the first copy of each stays: that of the
    smallest id (of equal ids, by a hash of the text), wherever its row is in the input.

    All columns are kept; the text is what is left of it (whole characters), and `length_col`, if there is
    such a column, its length. A null text stays null, an empty one empty. A document of which nothing is left
    is left out, so of rows equal in id and text one stays at most. See `removed_spans` for long texts, names
    and other cases.
    """
    kind, names = docs.schema, docs.columns
    text_at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def left(_, rest, data, covered):
        gone = covered[0]
        if len(data) and gone.all():
            return None
        told = rest[text_at]
        rest[text_at] = None
        if told:
            rest[text_at] = data[~gone].tobytes().decode()
            if length_at is not None:
                rest[length_at] = len(rest[text_at])
        return {f"o{i}": x for i, x in enumerate(rest)}

    carry = [named(n).isNotNull() if i == text_at else named(n) for i, n in enumerate(names)]
    schema = StructType([StructField(f"o{i}", f.dataType) for i, f in enumerate(kind)])
    found = removed_spans(docs, left, schema, scratch or Scratch(docs.sparkSession), id_col=id_col, text_col=text_col, carry=carry, lengths=[least], hot=hot)
    return found.select(*(F.col(f"o{i}").alias(f.name) for i, f in enumerate(kind)))
