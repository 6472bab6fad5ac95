"""Documents in blocks, and sums of keys over all blocks.

Operators that must know how often something occurs in the whole corpus work in rounds over blocks of
documents. A block is a row with some MB of its documents, written once to a bucketed table in the shared
folder, so that every round reads it in place and only small things are shuffled.

A block sends one packed row to each *part* of a key space. As long as a row for each bucket has a KB of text to
tell of, parts are the buckets, and one step goes there and one back. With more text such rows would become
more and smaller (n blocks and as many buckets: n * n rows), so from there on the way has two steps, as the
digits of a number: there are about as many parts as the square root of the buckets; a part's rows of one
*group* of blocks meet, are added up and go on, one packed row to each bucket of the part; answers go the same
way back. That makes some n * sqrt(n) rows, each still of a KB or more; no task holds more than a block, a
bucket or a group's share of a part; and a key that a third of all rows share comes to its bucket once for
each group. What is computed is the same either way.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docsluice.llm.common import Scratch, let_go, texts

BLOCK_BYTES = 6 << 20
#: A bucket's share of the text: its keys are those of so many bytes of text, about.
BUCKET_TEXT = 8 << 20
#: A block's row to a bucket tells of so many bytes of its text at least, or else goes in two steps.
ROW_TEXT = 1 << 10
SENT = "part long, block long, payload binary"
UP = "bucket long, part long, grp long, payload binary"
DOWN = "part long, grp long, payload binary"
ANSWER = "block long, payload binary"


def pack_ints(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, only as many planes as the largest needs."""
    values = np.ascontiguousarray(values).view(np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes, rows = np.empty((width, len(values)), np.uint8), values.view(np.uint8).reshape(-1, 8)
    for k in range(width):  # plane by plane takes a fraction of the time of one transposed copy
        planes[k] = rows[:, k]
    return struct.pack("<QB", len(values), width) + planes.tobytes()


def unpack_ints(data: memoryview) -> tuple[np.ndarray, memoryview]:
    n, width = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), np.uint8)
    for k, plane in enumerate(np.frombuffer(data, np.uint8, n * width, 9).reshape(width, n)):
        out[:, k] = plane
    return out.reshape(-1).view(np.uint64), data[9 + n * width :]


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: memoryview) -> tuple[np.ndarray, memoryview]:
    steps, rest = unpack_ints(data)
    return np.cumsum(steps, dtype=np.uint64), rest


def zigzag(values: np.ndarray) -> np.ndarray:
    values = np.asarray(values, np.int64)
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return h


def with_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable argsort of 64-bit keys, and the keys in that order. Keys are sorted with their places in the lowest bits,
    which takes a fraction of the time; where these bits were needed to tell keys apart, they are sorted by themselves."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), keys
    low = np.uint64((1 << n.bit_length()) - 1)
    most = int(keys.max())
    placed = keys << np.uint64(64 - most.bit_length() if most else 0)
    placed &= ~low
    placed |= np.arange(n, dtype=np.uint64)
    placed.sort()
    placed &= low
    order = placed.view(np.int64)
    ascending = keys[order]
    if not (ascending[1:] >= ascending[:-1]).all():
        order = np.argsort(keys, kind="stable")
        ascending = keys[order]
    return order, ascending


def sorted_order(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of 64-bit keys."""
    return with_order(keys)[0]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each entry's place among them, the entries in order of their keys, and where each key's begin there."""
    order, ascending = with_order(keys)
    new = np.ones(len(keys), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ascending[starts], place, order, starts


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each entry's place among them, and where each is first."""
    kinds, place, order, starts = grouped(keys)
    return kinds, place, order[starts]


def summed(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums (counts without values), and each entry's place among them."""
    kinds, place, _ = distinct(keys)
    if values is None:
        return kinds, np.bincount(place, minlength=len(kinds)).astype(np.int64), place
    count = np.zeros(len(kinds), np.int64)
    np.add.at(count, place, values)
    return kinds, count, place


class Dealt:
    """64-bit hashes (or their first `bits` bits, the keys) dealt to buckets by their top bits, in two steps."""

    def __init__(self, bits: int, bucket_bits: int):
        self.bits, self.bucket_bits = bits, min(bucket_bits, bits)
        one_step = (1 << self.bucket_bits) * ROW_TEXT <= BLOCK_BYTES
        self.part_bits = self.bucket_bits if one_step else self.bucket_bits // 2
        self.inner_bits = self.bucket_bits - self.part_bits
        self.groups = 1 << self.inner_bits

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def part_edges(self, keys: np.ndarray) -> np.ndarray:
        """Where each part's keys begin among ascending keys, and the end."""
        return _edges(keys, self.part_bits, self.bits)

    def inner_edges(self, keys: np.ndarray) -> np.ndarray:
        """The same for the buckets of a part, and keys without the part's bits."""
        return _edges(keys, self.inner_bits, self.bits - self.part_bits)

    def within_part(self, keys: np.ndarray) -> np.ndarray:
        return keys & np.uint64((1 << self.bits - self.part_bits) - 1)

    def within_bucket(self, keys: np.ndarray) -> np.ndarray:
        return keys & np.uint64((1 << self.bits - self.bucket_bits) - 1)

    def _grouped(self, sent: DataFrame) -> DataFrame:
        return sent.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(self.groups)))

    def settled(self, sent: DataFrame, gather: Callable[[pa.Table], pa.Table], settle: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """There: `gather` makes rows of UP of the rows of SENT of one part and group, and `settle` makes rows of
        `schema` of a bucket's rows of UP."""
        grouped = self._grouped(sent)
        if not self.inner_bits:  # a part is a bucket, and all blocks are one group
            return grouped.groupBy("part").applyInArrow(lambda rows: settle(gather(rows)), schema)
        # a bound method would seem to take the key too
        return grouped.groupBy("part", "grp").applyInArrow(lambda rows: gather(rows), UP).groupBy("bucket").applyInArrow(lambda rows: settle(rows), schema)

    def exchange(self, sent: DataFrame, gather: Callable, settle: Callable, deal: Callable, at_once: Callable | None = None) -> DataFrame:
        """There and back: `settle` makes rows of DOWN, and `deal`, from a part's and group's rows of SENT and of DOWN,
        rows of ANSWER. Rows of DOWN for part -1 have no rows of SENT. `at_once`, if given, makes the same rows of
        ANSWER of all rows of a part that is a bucket, adding them up once."""
        grouped = self._grouped(sent)
        if not self.inner_bits:

            def both(rows: pa.Table) -> pa.Table:
                if at_once:
                    return at_once(rows)
                down = settle(gather(rows))
                back = pa.compute.greater_equal(down["part"], 0)
                alone = down.filter(pa.compute.invert(back))
                return pa.concat_tables([deal(rows, down.filter(back)), *(deal(rows[:0], alone[i : i + 1]) for i in range(len(alone)))])

            return grouped.groupBy("part").applyInArrow(both, ANSWER)
        down = self.settled(sent, gather, settle, DOWN)
        return grouped.groupBy("part", "grp").cogroup(down.groupBy("part", "grp")).applyInArrow(lambda rows, answers: deal(rows, answers), ANSWER)


def _edges(keys: np.ndarray, top: int, bits: int) -> np.ndarray:
    return np.append(np.searchsorted(keys, np.arange(1 << top, dtype=np.uint64) << np.uint64(bits - top)), len(keys))


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows of SENT, UP, DOWN or ANSWER."""
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({n: pa.array(c, pa.binary() if t == "binary" else pa.int64()) for (n, t), c in zip(fields, columns, strict=True)})


def payloads_by(table: pa.Table, column: str) -> list[tuple[int, memoryview]]:
    """Payloads in the order of a column, the same wherever these rows meet again."""
    return sorted(zip(table[column].to_pylist(), (memoryview(x.as_buffer()) for x in table["payload"]), strict=True), key=lambda x: x[0])


class Keyed(Dealt):
    """Sums over the corpus of integers by key."""

    def send(self, block: int, keys: np.ndarray, sums: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Rows of SENT for ascending keys."""
        edges = self.part_edges(keys)
        return [(part, block, _packed(self.within_part(keys[a:b]), sums[a:b])) for part in np.flatnonzero(np.diff(edges)).tolist() for a, b in [edges[part : part + 2]]]

    def merge(self, sent: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Answers to the blocks: a part's number, and by how much the total of each key that the block sent it
        is above the block's own sum (no keys: the block knows their order; nothing, if all are equal). And one
        row for each bucket, with block -1 - bucket: its distinct keys with a total above 0, and the sum of all."""

        def gather(table: pa.Table) -> pa.Table:
            part, grp = table["part"][0].as_py(), table["grp"][0].as_py()
            keys, sums, *_ = _added([x for _, x in payloads_by(table, "block")])
            edges = self.inner_edges(keys)
            return table_of(UP, [(part << self.inner_bits | i, part, grp, _packed(self.within_bucket(keys[a:b]), sums[a:b])) for i in np.flatnonzero(np.diff(edges)).tolist() for a, b in [edges[i : i + 2]]])

        def add(table: pa.Table) -> pa.Table:
            bucket, part = table["bucket"][0].as_py(), table["part"][0].as_py()
            from_groups = payloads_by(table, "grp")
            _, totals, place, own, edges = _added([x for _, x in from_groups])
            more = totals[place] - own
            out = [(-1, bucket, struct.pack("<qq", int((totals > 0).sum()), int(totals.sum())))]
            for (grp, _), a, b in zip(from_groups, edges, edges[1:]):
                if more[a:b].any():
                    out.append((part, grp, struct.pack("<q", bucket & (1 << self.inner_bits) - 1) + pack_ints(zigzag(more[a:b]))))
            return table_of(DOWN, out)

        def deal(rows: pa.Table, answers: pa.Table) -> pa.Table:
            if not len(rows):
                return table_of(ANSWER, [(-1 - answers["grp"][0].as_py(), answers["payload"][0].as_py())])
            part, from_blocks = rows["part"][0].as_py(), payloads_by(rows, "block")
            keys, sums, place, own, edges = _added([x for _, x in from_blocks])
            totals = self._raised(sums, self.inner_edges(keys), answers["payload"])
            more, out = totals[place] - own, []
            for (block, _), a, b in zip(from_blocks, edges, edges[1:]):
                if more[a:b].any():
                    out.append((block, struct.pack("<q", part) + pack_ints(zigzag(more[a:b]))))
            return table_of(ANSWER, out)

        def at_once(rows: pa.Table) -> pa.Table:
            part, from_blocks = rows["part"][0].as_py(), payloads_by(rows, "block")
            _, totals, place, own, edges = _added([x for _, x in from_blocks])
            more, out = totals[place] - own, [(-1 - part, struct.pack("<qq", int((totals > 0).sum()), int(totals.sum())))]
            for (block, _), a, b in zip(from_blocks, edges, edges[1:]):
                if more[a:b].any():
                    out.append((block, struct.pack("<q", part) + pack_ints(zigzag(more[a:b]))))
            return table_of(ANSWER, out)

        return by_block(self.exchange(sent, gather, add, deal, at_once), scratch, name)

    @staticmethod
    def _raised(sums: np.ndarray, edges: np.ndarray, payloads) -> np.ndarray:
        out = sums.copy()
        for payload in payloads:
            data = memoryview(payload.as_buffer())
            (i,) = struct.unpack_from("<q", data)
            out[edges[i] : edges[i + 1]] += unzigzag(unpack_ints(data[8:])[0])
        return out

    def totals(self, keys: np.ndarray, sums: np.ndarray, payloads: pa.ChunkedArray) -> np.ndarray:
        """Totals over the corpus of the keys and sums that a block sent, from its answers (a column of one
        list, or a null)."""
        return self._raised(sums, self.part_edges(keys), payloads[0].values or [])


def _packed(keys: np.ndarray, sums: np.ndarray) -> bytes:
    return pack_keys(keys) + pack_ints(zigzag(sums))


def _added(payloads: list[memoryview]) -> tuple[np.ndarray, ...]:
    """Distinct keys of all payloads and their sums; each entry's place among them and own sum; where each
    payload's entries begin, and the end."""
    keys, sums = [], []
    for payload in payloads:
        k, rest = unpack_keys(payload)
        keys.append(k)
        sums.append(unzigzag(unpack_ints(rest)[0]))
    edges = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    every, own = np.concatenate(keys), np.concatenate(sums)
    order, every = with_order(every)
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    return every[first], np.add.reduceat(own[order], first) if len(first) else own, place, own, edges


def by_block(answers: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """ANSWER rows, one row for each block with all its payloads, written to a table that is bucketed as the
    blocks are: each round's answers are shuffled once and then read in place."""
    return scratch.bucketed(answers.groupBy("block").agg(F.collect_list("payload").alias("payloads")), "block", name)


def write_blocks(docs: DataFrame, columns: list[str], encode: Callable[[dict, int], dict], schema: str | StructType, scratch: Scratch, name: str, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """Write `docs` in blocks: `encode` makes a row (without its block number) of a list of documents.

    The table is bucketed by block, so grouping by block needs no exchange. A block is numbered by its
    input partition and its place there.
    """

    def run(batches):
        let_go()
        at = TaskContext.get().partitionId() << 20
        held, size = {c: [] for c in columns}, 0

        def flush(block):
            return pa.RecordBatch.from_pylist([{"block": block} | encode(held, block)], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            got = {c: texts(batch, c) if c == text_col else batch.column(c).to_pylist() for c in columns}
            for row in range(batch.num_rows):
                for c in columns:
                    held[c].append(got[c][row])
                size += len(got[text_col][row]) + 32
                if size >= block_bytes:
                    yield flush(at)
                    at, held, size = at + 1, {c: [] for c in columns}, 0
        if size:
            yield flush(at)

    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = StructType([StructField("block", LongType()), *fields])
    return scratch.bucketed(docs.select(*columns).mapInArrow(run, kind), "block", name)


def bucket_bits(total_text: int) -> int:
    return max(2, (max(1, total_text // BUCKET_TEXT) - 1).bit_length())


def key_bits(total_text: int, spare: int) -> int:
    """So many bits that a key meets another one by chance about once in 2**spare."""
    return min(64, max(16, total_text.bit_length() - 2) + spare)


def on_blocks(blocks: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str, **answers: DataFrame) -> DataFrame:
    """Run on each block, one at a time, with the answers to it as further columns of these names. Blocks and
    answers are bucketed alike, so neither is shuffled."""
    for name, df in answers.items():
        blocks = blocks.join(df.withColumnRenamed("payloads", name), "block", "left")

    def alone(table: pa.Table) -> pa.Table:
        let_go()
        return run(table)

    return blocks.groupBy("block").applyInArrow(alone, schema)


def stats(answers: DataFrame) -> tuple[int, int]:
    """Distinct keys with a total above 0, and the sum over all keys (from each bucket's row)."""

    def read(batches):
        for batch in batches:
            pairs = [struct.unpack("<qq", x) for row in batch.column("payloads").to_pylist() for x in row]
            yield pa.RecordBatch.from_pydict({"kinds": pa.array([p[0] for p in pairs], pa.int64()), "total": pa.array([p[1] for p in pairs], pa.int64())})

    row = answers.where("block < 0").select("payloads").mapInArrow(read, "kinds long, total long").agg(F.sum("kinds"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0
