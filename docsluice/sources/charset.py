"""Which code page bytes are in, and which two a text has been through: by frequencies of character pairs in a corpus.

A model has the pairs of neighbouring characters of which one isn't ASCII, as the corpus has them. For each code page they
become a table over pairs of bytes, so a content is scored for all pages at once, by its pairs with a high byte.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The one-byte code pages that are told apart, those that come first win ties.
PAGES = ("cp1252", "cp1254", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp1253", "cp1257", "cp850", "cp437", "mac-roman")
#: Pairs a model keeps, the most frequent ones: what comes to the driver.
MOST_PAIRS = 50_000
#: What a byte that a page doesn't have costs, and how much likelier a repaired text must be, in natural logarithms.
UNDEFINED, MARGIN = -50.0, 4.0
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def _codes(text: str) -> np.ndarray:
    """Pairs of neighbouring characters of which one isn't ASCII, as numbers; the text's ends count as line feeds."""
    c = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-1] << 21 | c[1:])[(c[:-1] > 127) | (c[1:] > 127)]


@dataclass
class PairModel:
    pairs: np.ndarray
    logs: np.ndarray
    unseen: float
    tables: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        for page in PAGES:
            letters = np.array([ord(bytes([b]).decode(page, "replace")) for b in range(256)], np.int64)
            table = self._logs(letters[:, None] << 21 | letters[None])
            missing = letters == 0xFFFD
            table[missing[:, None] | missing[None]] = UNDEFINED
            self.tables[page] = table.ravel().astype(np.float32)

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(codes.shape, self.unseen)
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return np.where(self.pairs[at] == codes, self.logs[at], self.unseen)

    def of_text(self, text: str) -> float:
        """How likely a text's pairs are."""
        return float(self._logs(_codes(text)).sum())

    def page_of(self, content: bytes) -> str:
        """The encoding of a content: by its mark, as UTF-8 where it is that, else the likeliest one-byte page."""
        for mark, name in MARKS:
            if content.startswith(mark):
                return name
        try:
            content.decode()
            return "utf-8"
        except UnicodeDecodeError:
            return self.one_byte_page(content)[0]

    def one_byte_page(self, content: bytes) -> tuple[str, float]:
        b = np.frombuffer(b"\n" + content + b"\n", np.uint8).astype(np.int64)
        pairs = (b[:-1] << 8 | b[1:])[(b[:-1] > 127) | (b[1:] > 127)]
        scores = [float(self.tables[p][pairs].sum(dtype=np.float64)) for p in PAGES]
        best = int(np.argmax(scores))
        return PAGES[best], scores[best]

    def decode(self, content: bytes) -> str:
        return content.decode(self.page_of(content), "replace")

    def repair(self, text: str, rounds: int = 2) -> str:
        """The text as it was before it was read in a wrong code page, once or twice; itself, if no other reading is likelier by
        `MARGIN`. All pairs of pages are tried: the bytes under the page it was read in, read as UTF-8 or in the likeliest page."""
        for _ in range(rounds):
            now, best = self.of_text(text) + MARGIN, None
            if now == MARGIN:  # nothing but ASCII
                break
            for wrong in (*PAGES, "latin-1"):
                try:
                    content = text.encode(wrong)
                except UnicodeEncodeError:
                    continue
                try:
                    other = content.decode()
                except UnicodeDecodeError:
                    page, score = self.one_byte_page(content)
                    other = content.decode(page, "replace") if score > now else text
                if other != text and (score := self.of_text(other)) > now:
                    now, best = score, other
            if best is None:
                break
            text = best
        return text


def learn_pairs(texts: DataFrame, text_col: str = "text", most: int = MOST_PAIRS) -> PairModel:
    """A model of all the texts: pairs are counted in the tasks and added up; null texts have none. The most frequent `most` come
    to the driver."""

    def count(batches):
        kinds, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            found = [_codes(x) for x in batch.column(0).to_pylist() if x]
            code, n = np.unique(np.concatenate([kinds, *found]) if found else kinds, return_counts=True)
            n[np.searchsorted(code, kinds)] += counts - 1
            kinds, counts = code, n
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(counts)], ["pair", "n"])

    pairs = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = pairs.orderBy(F.desc("n"), "pair").limit(most).collect()
    total = sum(r["n"] for r in rows) + 1
    rows.sort(key=lambda r: r["pair"])
    return PairModel(np.array([r["pair"] for r in rows], np.int64), np.log(np.array([r["n"] for r in rows], float) / total), float(np.log(0.1 / total)))


def decoded(model: PairModel):
    """A function of a binary column: the text."""
    sent = _sent(model)

    @F.pandas_udf(StringType())
    def run(content: pd.Series) -> pd.Series:
        return content.map(sent.value.decode, na_action="ignore")

    return run


def repaired(model: PairModel):
    """A function of a text column: `PairModel.repair` of it."""
    sent = _sent(model)

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(sent.value.repair, na_action="ignore")

    return run


def _sent(model: PairModel):
    """The model as a broadcast: some 4 MB."""
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)
