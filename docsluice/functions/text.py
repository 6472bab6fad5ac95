"""Text functions: column builders, and Arrow UDFs where Spark has no built-in."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode form KC; a null stays null."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def repair_encoding(text: pd.Series) -> pd.Series:
    """Undo UTF-8 that was read as a one-byte encoding, where the way back succeeds and shortens the text."""

    def fix(x: str) -> str:
        for wrong in ("cp1252", "latin-1"):
            try:
                y = x.encode(wrong).decode("utf-8")
            except UnicodeError:
                continue
            if len(y) < len(x):
                return y
        return x

    return text.map(fix, na_action="ignore")


def normalize(text: Column, unicode_form: bool = False) -> Column:
    """For comparing quotes and for search: form KC (on demand: it costs a Python step, and most stored text
    has it already), lower case, white space as one space, trimmed; null as ''."""
    text = F.coalesce(nfkc(text) if unicode_form else text, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def strip_junk(text: Column) -> Column:
    """Without control, format, unassigned and private characters (line feeds and tabs stay) and U+FFFD."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]|\x{FFFD}", "")


def clean_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(strip_junk(text), r"(?U)[^\S\n]+", " "))


def garbage_count(text: Column) -> Column:
    """Characters that `strip_junk` drops, but for carriage returns."""
    return F.length(text) - F.length(F.regexp_replace(text, r"[\p{C}&&[^\n\t\r]]|\x{FFFD}", ""))


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def lexemes(text: Column) -> Column:
    """Search tokens of a normalised text: runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(r"((?U)\w+)"), F.lit(1))


@cache
def _folds() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they decompose to, U+00C0 to U+024F."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(text: Column) -> Column:
    return F.translate(text, *_folds())


def sentences(text: Column) -> Column:
    """Parts after . ! or ? and white space; blank ones dropped."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.filter(F.transform(F.split(trimmed, r"(?U)(?<=[.!?])\s+"), F.trim), lambda x: x != "")


def flatten_table(data: Column) -> Column:
    """Rows of cells as lines: nulls empty, cells trimmed and parted by ' | '."""
    return F.array_join(F.transform(data, lambda row: F.array_join(F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")), "\n")


def covers(claim: Column, sentence: Column) -> Column:
    """Either contains the other; empty ones never (both normalised)."""
    return (claim != "") & (sentence != "") & (sentence.contains(claim) | claim.contains(sentence))


# Frequent short words of the languages that are told apart.
FREQUENT = {
    "tr": "ve bir bu için ile de da olarak daha çok gibi olan her kadar sonra ne ama en var değil veya ancak göre ki",
    "en": "the and of to in is that for it with as was on are be this by at from or not which have an they",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "le les et des la du une est dans que pour qui sur pas par plus au avec ce sont ne se cette ont aux",
    "es": "el los y las la del que en una por con para es se no su lo como más al son pero sus ha",
    "it": "il di che la è per un una del della non si con sono le da dei gli nel alla più anche come ma lo",
}


def detect_language(text: Column, least_chars: int = 20) -> Column:
    """The language whose frequent words the text has most of (of equals the first by name); null if it has none of
    any, and for texts of fewer characters."""
    lower = words(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}\d]+", " "))

    def most(text_words: Column) -> Column:
        def hits(these: str) -> Column:
            return F.size(F.filter(text_words, lambda w: w.isin(*these.split())))

        return F.array_max(F.array(*(F.struct(hits(these).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, these) in enumerate(sorted(FREQUENT.items())))))

    best = F.element_at(F.transform(F.array(lower), most), 1)  # the words are made once
    return F.when((F.length(F.trim(text)) >= least_chars) & (best["n"] > 0), best["lang"])


@cache
def _tokenizer(path: str):
    import tokenizers

    made = tokenizers.Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def subword_spans(tokenizer: str):
    """A function of a text column: the tokens of a tokenizer file as (start, end) in characters. Workers load the
    file once; a null text has none. `F.size` of it counts tokens."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(text: pd.Series) -> pd.Series:
        whole = _tokenizer(tokenizer).encode_batch(["" if x is None else x for x in text], add_special_tokens=False)
        return pd.Series([[{"start": a, "end": b} for a, b in e.offsets] for e in whole])

    return spans
