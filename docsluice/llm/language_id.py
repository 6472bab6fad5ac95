"""Language ID by bit-sliced Bloom filters over character n-grams.

A slot of the filter is a bit mask with a bit per language, in as many words of 64 bits as the languages
need. The masks at an n-gram's slots, and-ed, tell
all languages that have the n-gram at once (or seem to, by chance). A text's hits are counted for each
language, the hits expected by chance are taken off, and the language with most hits left is the answer.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.common import TwoGenerationCache, held, named, texts

SIZES = (2, 3, 4, 5)
HASHES = 3
#: Rows of a language used to learn: about this many, chosen by a hash of their ids.
FIT_ROWS = 6000
#: An n-gram belongs to a language if this share of the language's n-grams of its size is it.
LEAST_SHARE = 5e-6
#: Bits a language may have set in the filter, as a share of all slots.
FILL = 0.15
EDGE = 0x20
_LETTERS = regex.compile(r"\p{L}+")


def hashed_ngrams(codes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams in words set one after the other, each with an edge mark around it,
    and the word of each n-gram. codes: code points, every word's first mark at `starts`; a last mark ends."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    edge = codes == EDGE
    inner = np.cumsum(edge)  # marks up to and with each place
    at = np.arange(len(h))
    # no mark strictly inside
    ok = inner[at + n - 2] == inner[at] if n > 1 else ~edge[at]
    at = at[ok]
    return h[at], np.searchsorted(starts, at, "right") - 1


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    text = " " + " ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return codes, np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def chunk_words(chunk: str) -> list[str]:
    return _LETTERS.findall(chunk.lower())


@dataclass
class LanguageFilter:
    """The learned filter: masks of the slots (a row for each 64 languages), the languages in bit order, each
    language's fill."""

    languages: list[str]
    masks: np.ndarray
    fill: np.ndarray
    sizes: tuple[int, ...] = SIZES
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def build(cls, languages: list[str], grams: dict[str, np.ndarray], sizes: tuple[int, ...] = SIZES) -> LanguageFilter:
        """grams: each language's n-gram hashes."""
        most = max([1, *map(len, grams.values())])
        slots = 1 << max(10, int(np.ceil(np.log2(most * HASHES / FILL))))
        masks = np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64)
        for bit, lang in enumerate(languages):
            for at in cls._slots(grams[lang], slots):
                masks[bit // 64, at] |= np.uint64(1 << bit % 64)
        fill = np.array([np.mean(masks[bit // 64] >> np.uint64(bit % 64) & np.uint64(1)) for bit in range(len(languages))])
        return cls(languages, masks, fill, sizes)

    @staticmethod
    def _slots(h: np.ndarray, slots: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            step = (h >> np.uint64(32)) | np.uint64(1)
            return [((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]

    def hits(self, words: list[str]) -> np.ndarray:
        """For each word: its n-grams, then those that each language's filter has."""
        out = np.zeros((len(words), 1 + len(self.languages)), np.int64)
        if not words:
            return out
        codes, starts = word_codes(words)
        for n in self.sizes:
            h, word = hashed_ngrams(codes, starts, n)
            found = np.full((len(self.masks), len(h)), ~np.uint64(0), np.uint64)
            for at in self._slots(h, self.masks.shape[1]):
                found &= self.masks[:, at]
            out[:, 0] += np.bincount(word, minlength=len(words))
            for bit in range(len(self.languages)):
                out[:, 1 + bit] += np.bincount(word[(found[bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(bool)], minlength=len(words))
        return out

    def decide(self, counts: list[int]) -> tuple[str, float]:
        """counts: n-grams, then hits by language. The share of n-grams left after the chance hits are
        taken off is the score; of equal ones the first language in order wins."""
        n = max(counts[0], 1)
        chance = self.fill**HASHES
        share = (np.asarray(counts[1:]) / n - chance) / (1 - chance)
        best = int(np.argmax(share))
        return self.languages[best], float(min(1.0, max(0.0, share[best])))


def fit_language_filter(docs: DataFrame, train: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, least_share: float = LEAST_SHARE, sizes: tuple[int, ...] = SIZES) -> LanguageFilter:
    """Learn from rows with a language (and `train`): about `fit_rows` of each language, chosen by a hash
    of the id, all if there are fewer. What comes to the driver is bounded: at most 1 / least_share n-grams of
    a size and language, 12 bytes each. Without a labelled row no language is learned, and every
    prediction is `und`. Rows with a null id share one hash, and are taken or left together."""
    rows = docs.where(named(lang_col).isNotNull() & (F.lit(True) if train is None else train)).select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang"))
    sizes_by = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes_by:
        return LanguageFilter.build([], {}, sizes)
    share = F.create_map(*[x for lang, n in sizes_by.items() for x in (F.lit(lang), F.lit(min(1.0, fit_rows / n)))])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def run(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text"), strict=True):
                words.setdefault(lang, Counter()).update(chunk_words(text))
        for lang, count in words.items():
            known = list(count)
            if not known:
                continue
            weight = np.fromiter(count.values(), np.int64, len(known))
            codes, starts = word_codes(known)
            for n in sizes:
                h, word = hashed_ngrams(codes, starts, n)
                kinds, place = np.unique(h, return_inverse=True)
                total = np.bincount(place, weight[word], len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(kinds), pa.string()), "size": pa.array(np.full(len(kinds), n), pa.int64()), "gram": pa.array(kinds.view(np.int64)), "n": pa.array(total)})

    grams = chosen.mapInArrow(run, "lang string, size long, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    kept = grams.withColumn("all", F.sum("n").over(Window.partitionBy("lang", "size"))).where(F.col("n") >= F.greatest(F.lit(2), F.col("all") * least_share)).select("lang", "gram")
    languages = sorted(sizes_by)
    numbers = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    found = kept.select(numbers[F.col("lang")].alias("number"), "gram").toArrow()
    langs, hashes = found["number"].to_numpy(), found["gram"].to_numpy().view(np.uint64)
    return LanguageFilter.build(languages, {lang: hashes[langs == i] for i, lang in enumerate(languages)}, sizes)


class _Scorer:
    """Chunks' counts as one integer with 32 bits a count, so that a text's counts are a plain sum."""

    def __init__(self, model: LanguageFilter, cache: int = 150_000):
        self.model, self.cache = model, TwoGenerationCache(cache)

    def learn(self, chunks: list[str]) -> None:
        new = self.cache.unknown(chunks)
        words = [chunk_words(c) for c in new]
        flat = [w for ws in words for w in ws]
        counts = self.model.hits(flat).tolist()
        at = 0
        for c, ws in zip(new, words, strict=True):
            total = 0
            for row in counts[at : at + len(ws)]:
                total += sum(x << 32 * i for i, x in enumerate(row))
            at += len(ws)
            self.cache.young[c] = total

    def predict(self, batch: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for a in range(0, len(batch), 64):
            split = [(x or "").split() for x in batch[a : a + 64]]
            self.learn([c for chunks in split for c in chunks])
            known = self.cache.young
            for chunks in split:
                total = sum([known[c] for c in chunks])
                counts = [total >> 32 * i & 0xFFFFFFFF for i in range(1 + len(self.model.languages))]
                lang, score = self.model.decide(counts) if counts[0] and len(counts) > 1 else ("und", 0.0)
                langs.append(lang)
                scores.append(score)
        return langs, scores


def identify_language(docs: DataFrame, model: LanguageFilter, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its score to every row; input columns of these names are replaced.

    Only the text is looked at, all of it. A null text or one without a letter is `und` with score 0; repeated rows are judged alike; other
    columns are handed on, of any names. One pass, no
    shuffle; the filter (of a size bounded by the fit) is a broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_out, score_out)
    columns = docs.columns
    text_at = columns.index(text_col)
    docs = docs.toDF(*(f"c{i}" for i in range(len(columns))))  # names may have dots
    schema = docs.select("*", F.lit("").alias("lang"), F.lit(0.0).alias("score")).schema

    def run(batches):
        scorer = held(("language", sent.value.key), lambda: _Scorer(sent.value))
        for batch in batches:
            langs, scores = scorer.predict(batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang", "score"])

    return docs.mapInArrow(run, schema).toDF(*columns, lang_out, score_out)
