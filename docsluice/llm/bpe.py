"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from docsluice.llm.common import TwoGenerationCache, held, named, texts


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: bytes that print as themselves keep their
    code point, the others get the code points from 256 on, in order."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(free)) for b in range(256)]


class WordBpe:
    """A tokenizer file with NFC, lower case, dropped white space and an end-of-word suffix.

    Encoding follows the file: strings of added tokens are cut out of the raw text first, each part
    between them is normalised, cut into words by the file's pattern and merged word by word.
    """

    def __init__(self, spec: bytes, cache: int = 250_000):
        loaded = json.loads(spec)
        model = loaded["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in loaded["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.added).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault((self.vocab[left], self.vocab[right]), (rank, self.vocab[left + right]))
        letters = byte_alphabet()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        steps = loaded["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split"))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.word_ids = TwoGenerationCache(cache)
        self.chunks = TwoGenerationCache(cache)

    def merge_word(self, word: str) -> list[int]:
        """Ids of one word. Queue entries are (rank, place, left id, right id, merged id); an entry
        whose symbols changed since it was pushed is stale and is skipped when popped."""
        data = word.encode()
        symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = self.merges.get
        queue = []
        for i in range(n - 1):
            if found := known((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, left, right, merged = heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := known((merged, symbols[k])):
                    heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := known((symbols[h], merged))):
                heappush(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def _words(self, part: str) -> list[str]:
        text = unicodedata.normalize("NFC", part)
        # lower() looks at a final sigma's neighbours, the file's lower case does not
        return self.words.findall(text.replace("Σ", "σ").lower())

    def _part(self, part: str) -> list[int]:
        words = self._words(part)
        for w in self.word_ids.unknown(words):
            self.word_ids.young[w] = self.merge_word(w)
        known = self.word_ids.young
        return [i for w in words for i in known[w]]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self._part(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings one after the other; the file names no decoder, so a space parts them."""
        return " ".join(map(self.strings.__getitem__, ids))

    def encode_and_decode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text.

        A text is cut at white space first: no word crosses it and no normalisation reaches over it, so
        the results of equal chunks are shared. Texts with added tokens or with separators that are
        white space for Python alone go the plain way."""
        if "<|" in text and self.cut.search(text) or _ODD.search(text):
            ids = self.encode(text)
            return " ".join(map(str, ids)), self.decode(ids)
        chunks = text.split()
        for c in self.chunks.unknown(chunks):
            ids = self._part(c)
            self.chunks.young[c] = " ".join(map(str, ids)), self.decode(ids)
        known = self.chunks.young
        both = [known[c] for c in chunks]
        return " ".join([x[0] for x in both]), " ".join([x[1] for x in both])


#: White space for str.split() but not for the tokenizer's pattern.
_ODD = re.compile("[\x1c-\x1f]")


def word_bpe(spec: bytes) -> WordBpe:
    """The model of a tokenizer file, kept while a Python worker works on its stage."""
    return held(("word bpe", hashlib.sha256(spec).hexdigest()), lambda: WordBpe(spec))


def bpe_round_trip(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", keep_texts: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row per document, repeated rows included: the id column (null stays null), n_tokens,
    ids_sha256 over the decimal ids joined by one space, decoded_sha256 over the decoded text, and with
    `keep_texts` the arrays and texts themselves (`ids`, `decoded`). A null or empty text has no tokens;
    both digests are those of the empty string. Other columns are not looked at. One pass, no shuffle:
    the tokenizer file is read on the driver and sent as one broadcast of its own, fixed size.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_file, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_texts

    def run(batches):
        model = word_bpe(spec.value)
        for batch in batches:
            n, a, b, ids, decoded = [], [], [], [], []
            for text in texts(batch, "text"):
                x, y = model.encode_and_decode(text)
                n.append(x.count(" ") + 1 if x else 0)
                a.append(hashlib.sha256(x.encode()).hexdigest())
                b.append(hashlib.sha256(y.encode()).hexdigest())
                if keep_texts:
                    ids.append([int(i) for i in x.split()])
                    decoded.append(y)
            columns = {"id": batch.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if keep_texts:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
