"""Token ids in binary files: one concatenated id array, document boundaries in Elias-Fano code."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.bpe import byte_alphabet
from docsluice.llm.common import Scratch, held, named, pieces, text_bytes, texts

MAGIC = b"DSTOK001"
HEAD = struct.Struct("<8sQQQBBxxxxxx")  # magic, documents, ids, select step, bytes an id, low bits
FILE_TEXT_BYTES = 20 << 20
FILE_IDS = 16 << 20


class EliasFano:
    """A non-decreasing sequence of n values below `universe` in about n * (2 + log2(universe / n)) bits.

    The low bits lie packed; the high parts are a bit vector with the i-th one at high(i) + i. The place
    of every `step`-th one is kept, so select finds a value by reading a few words after that place.
    """

    STEP = 256

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        high = values >> np.uint64(low_bits)
        ones = (high + np.arange(n, dtype=np.uint64)).astype(np.int64)
        bits = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        bits[ones] = 1
        planes = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0))
        return cls(n, low_bits, np.packbits(planes.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[:: cls.STEP].astype(np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled one on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // self.STEP])
        left = i % self.STEP
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        first = i * self.low_bits
        last = first + self.low_bits
        low = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little") >> (first % 8) & ((1 << self.low_bits) - 1)
        return high << self.low_bits | low

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        planes = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return high | (planes.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A file's bytes: header; ids of documents as 64-bit integers and a byte each that tells nulls;
    sizes of the three Elias-Fano parts, the parts; the token ids, `width` bytes each, little-endian."""
    ends = np.cumsum(np.asarray(lengths, np.uint64))
    code = EliasFano.build(ends, len(ids) // width + 1)
    parts = [code.low.tobytes(), code.high.tobytes(), code.samples.astype("<u8").tobytes()]
    return b"".join([
        HEAD.pack(MAGIC, len(doc_ids), len(ids) // width, EliasFano.STEP, width, code.low_bits),
        np.asarray([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids),
        struct.pack("<QQQ", *map(len, parts)), *parts, ids,
    ])


class TokenFile:
    """A file of `pack_file`, read from bytes."""

    def __init__(self, data: bytes):
        magic, n, self.n_ids, step, self.width, low_bits = HEAD.unpack_from(data)
        if magic != MAGIC or step != EliasFano.STEP:
            raise ValueError("not a token file of this version")
        at = HEAD.size
        ids = np.frombuffer(data, "<i8", n, at)
        nulls = data[at + 8 * n : at + 9 * n]
        self.doc_ids = [None if null else int(x) for x, null in zip(ids, nulls, strict=True)]
        at += 9 * n
        a, b, c = struct.unpack_from("<QQQ", data, at)
        at += 24
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        self.ends = EliasFano(n, low_bits, low, high, np.frombuffer(data, "<u8", c // 8, at + a + b))
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + a + b + c)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.ids[start:end]


class RankEncoder:
    """A byte-level tokenizer file, read as ranks.

    Where the file's ids ascend with its merges, the lowest merge is the one with the lowest id, so the ranks
    alone (tokens' bytes with their ids) give the same ids, and a whole text is encoded by them at once. Texts with
    an added token's string go through the tokenizers library, and so do all texts of a file of another order."""

    def __init__(self, spec: bytes, width: int, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.type = Tokenizer.from_str(spec.decode()), f"<u{width}"
        self.added = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        model, byte_of = json.loads(spec)["model"], {c: b for b, c in enumerate(byte_alphabet())}
        vocab = {t: i for t, i in model["vocab"].items() if set(t) <= byte_of.keys()}
        merged = [vocab.get("".join(x) if isinstance(x, list) else x.replace(" ", "", 1), -1) for x in model["merges"]]
        in_order = len(merged) + 256 == len(vocab) and merged == sorted(set(merged)) and merged[:1] >= [256]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.by_ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if in_order else None

    def encode(self, text: str) -> bytes:
        """Ids as packed integers."""
        if self.by_ranks is None or self.added.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        return np.asarray(self.by_ranks(text), self.type).tobytes()


def rank_encoder(spec: bytes, width: int, pattern: str) -> RankEncoder:
    return held(("ranks", hashlib.sha256(spec).hexdigest(), width, pattern), lambda: RankEncoder(spec, width, pattern))


def write_token_files(docs: DataFrame, tokenizer_file: str, pattern: str, out: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Write all documents' ids, ascending by id (nulls first), each document closed by `end_id`.

    An id that is no integer counts as null. Only the id and the text are looked at. The files and the manifest
    are in `scratch`, or the files in `out`. Returns the manifest: path, start (ids in all files before), n_docs, n_ids; one row per file. A null
    or empty text is the end id alone; `pattern` is the byte-level pretoken pattern of the tokenizer's kind; repeated ids stand side by side, ordered by a hash of the text.
    Rows are dealt by ranges of (id, text hash, a random number), so not even one id that a third of the
    rows share falls to one task. Each task writes files of at most `FILE_IDS` ids and one document more,
    under names of its own: a task that is run again leaves the first attempt's files out of the manifest.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    out = out or scratch.path("tokens")
    with open(tokenizer_file, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    parts = pieces(text_bytes(docs, text_col), FILE_TEXT_BYTES)
    rows = docs.select(named(id_col).try_cast("long").alias("id"), named(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order, F.rand(1)).sortWithinPartitions(*order)

    def run(batches):
        loaded = json.loads(spec.value)
        top = max([end_id, *loaded["model"]["vocab"].values(), *(x["id"] for x in loaded["added_tokens"])])
        width = 2 if top < 1 << 16 else 4
        encoder, end = rank_encoder(spec.value, width, pattern), end_id.to_bytes(width, "little")
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(base, recursive=True)
        part, ids, lengths, data, seq, size = TaskContext.get().partitionId(), [], [], [], 0, 0

        def flush():
            name = f"{base}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(name) as f:
                f.write(pack_file(ids, lengths, b"".join(data), width))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [name], "n_docs": [len(ids)], "n_ids": [size]})

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), texts(batch, "text"), strict=True):
                one = encoder.encode(text) + end
                ids.append(doc)
                lengths.append(len(one) // width)
                data.append(one)
                size += lengths[-1]
                if size >= FILE_IDS:
                    yield flush()
                    ids, lengths, data, seq, size = [], [], [], seq + 1, 0
        if ids:
            yield flush()

    manifest = scratch.saved(dealt.mapInArrow(run, "part long, seq long, path string, n_docs long, n_ids long"), "manifest")
    at = Window.orderBy("part", "seq")
    return manifest.select("path", (F.sum("n_ids").over(at) - F.col("n_ids")).alias("start"), "n_docs", "n_ids", F.lit(out).alias("base"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids (array of long)."""
    return _read(manifest, "ids array<long>", lambda x: [int(i) for i in x], pa.list_(pa.int64()))


def digest_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 over 32-bit ids."""
    return _read(manifest, "ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64())


def _read(manifest: DataFrame, column: str, of, kind: pa.DataType) -> DataFrame:
    name = column.split()[0]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["base"])
                with fs.open_input_stream(row["path"]) as f:
                    file = TokenFile(f.read())
                for a in range(0, len(file), 4096):
                    spans = [file.span(i) for i in range(a, min(a + 4096, len(file)))]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(file.doc_ids[a : a + 4096], pa.int64()), "start": pa.array([row["start"] + x for x, _ in spans], pa.int64()),
                        "n_tokens": pa.array([y - x for x, y in spans], pa.int64()), name: pa.array([of(file.ids[x:y]) for x, y in spans], kind),
                    })

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
