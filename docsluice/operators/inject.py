"""Rule-based scan for prompt injection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, case-insensitive.
PATTERNS = (
    r"ignore\s+(all\s+|the\s+)?(previous|prior|above|earlier|preceding)\s+(instructions?|prompts?|messages?|context|rules?)",
    r"disregard\s+(all\s+|the\s+|any\s+)?(previous|prior|above|earlier|preceding)",
    r"forget\s+(everything|all|(the\s+)?(previous|prior)\s+(instructions?|context))",
    r"you\s+are\s+now\s+(a|an|the)?\s*\w+",
    r"act\s+as\s+(a|an|if)\b",
    r"pretend\s+(to\s+be|you\s+are)\b",
    r"system\s+prompt\b",
    r"new\s+instructions?\s*[:\-]",
    r"override\s+(the\s+)?(system|instructions?|previous)",
    r"do\s+not\s+follow\s+(the\s+)?(previous|above|system)",
    r"(önceki|yukarıdaki|tüm|bütün)\s+(talimatlar[ıi]?|komutlar[ıi]?|yönergeleri?|kurallar[ıi]?)\s*(['’]?[ıi]?)?\s*(yoksay|görmezden\s+gel|unut|dikkate\s+alma|umursama)",
    r"(bundan\s+sonra|artık)\s+(sen|şu\s+şekilde|şöyle)\b",
    r"rol(ün[üu])?\s+değiştir",
    r"sistem\s+(istemi|komutu|talimat[ıi]|mesaj[ıi])",
    r"yeni\s+talimat(lar)?\s*[:\-]",
    r"(şu\s+şekilde|şöyle|.+?\s+gibi)\s+davran",
    r"talimatlar[ıi]\s+unut",
)
# Zero-width characters and marks, embeddings and overrides, isolates.
HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


#: What a text must hold, of each list one, before a pattern is tried: words of the pattern, in lower case, ı as i.
NEEDED = (
    (("ignore",),), (("disregard",),), (("forget",),), (("you",), ("are",), ("now",)), (("act",), ("as",)), (("pretend",),), (("system",), ("prompt",)), (("new",), ("instruction",)),
    (("override",),), (("follow",),), (("talimat", "komut", "yönerge", "kural"),), (("bundan", "artik"),), (("rol",), ("değiştir",)), (("sistem",),), (("yeni",), ("talimat",)), (("davran",),), (("talimatlar",),),
)


def folded(text: Column) -> Column:
    """Lower case for finding words: each letter that a pattern's i, k or s also matches is that letter."""
    odd = F.contains(text, F.lit("ı")) | F.contains(text, F.lit("İ")) | F.contains(text, F.lit("ſ")) | F.contains(text, F.lit("\u212a"))
    return F.when(odd, F.lower(F.translate(text, "ıİſ\u212a", "iisk"))).otherwise(F.lower(text))


def _if(there: Column, found: Column, kind: str = "array<string>") -> Column:
    """`found`, looked for only where a cheap scan finds what it can't do without."""
    return F.when(there, found).otherwise(F.array().cast(kind))


def _each(text: Column, low: Column, patterns: tuple[str, ...], use, kind: str = "array<string>") -> list[Column]:
    """`use` of each pattern (in its case-insensitive form) where the text can match it. low: the text folded."""
    out = []
    for i, p in enumerate(patterns):
        found = use(i, f"(?iuU){p}")
        if patterns == PATTERNS:
            there = F.lit(True)
            for some in NEEDED[i]:
                there = there & reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in some))
            found = _if(there, found, kind)
        out.append(found)
    return out


def pattern_evidence(text: Column, patterns: tuple[str, ...] = PATTERNS, low: Column | None = None) -> Column:
    """All matches, pattern by pattern, cut to 80 characters. low: `folded(text)` as a column, if there is one."""
    each = _each(text, folded(text) if low is None else low, patterns, lambda _, p: _found(text, p))
    return F.transform(F.flatten(F.array(*each)), lambda x: F.substring(x, 1, 80))


def pattern_spans(text: Column, patterns: tuple[str, ...] = PATTERNS, low: Column | None = None) -> Column:
    """All matches, pattern by pattern: (pattern, start, end), in characters from 0, the end behind the match.

    A match begins behind what lies between the matches before, and these."""
    kind = "array<struct<pattern:int,start:int,end:int>>"

    def spans(i: int, pattern: str) -> Column:
        pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), _found(text, pattern).alias("match"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.char_length(x["gap"])
            end = start + F.char_length(x["match"])
            return F.when(x["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(i).alias("pattern"), start.alias("start"), end.alias("end")))).alias("out")))

        return F.aggregate(pairs, begin, step, lambda acc: acc["out"])

    return F.flatten(F.array(*_each(text, folded(text) if low is None else low, patterns, spans, kind)))


def base64_runs(text: Column, least: int = 40) -> Column:
    """Long runs of the alphabet with a + or / or padded: hexadecimal digests have neither."""
    run = f"[A-Za-z0-9+/]{{{least},}}"
    return _if(text.rlike(run), F.filter(_found(text, run + "={0,2}"), lambda x: x.rlike(r"[+/]|=$")))


def homoglyph_words(text: Column) -> Column:
    """Words of Latin letters together with Cyrillic or Greek ones."""
    other = r"[\p{IsCyrillic}\p{IsGreek}]"
    return _if((F.octet_length(text) > F.char_length(text)) & text.rlike(other), F.filter(_found(text, r"(?U)\w+"), lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(other)))


def scan(docs: DataFrame, text_col: str = "text", raw_col: str | None = None, *, patterns: tuple[str, ...] = PATTERNS, enabled: bool = True, hidden_least: int = 1, base64_least: int = 40, homoglyph_least: int = 2) -> DataFrame:
    """Adds counts by rule and `injection_flag`. Hidden characters are looked for in the raw text, as cleaning
    removes them; the other rules in the cleaned text. A null text is empty."""
    text = F.coalesce(text_col, F.lit(""))
    raw = F.coalesce(raw_col or text_col, F.lit(""))
    hidden = F.when(F.octet_length(raw) > F.char_length(raw), F.regexp_count(raw, F.lit(HIDDEN))).otherwise(0)
    counted = docs.withColumn("__low", folded(text)).withColumns({
        "pattern_count": F.size(pattern_evidence(text, patterns, F.col("__low"))), "hidden_count": hidden,
        "base64_count": F.size(base64_runs(text, base64_least)), "homoglyph_count": F.size(homoglyph_words(text)),
    }).drop("__low")
    flag = (F.col("pattern_count") >= 1) | (F.col("base64_count") >= 1) | (F.col("hidden_count") >= hidden_least) | (F.col("homoglyph_count") >= homoglyph_least)
    return counted.withColumn("injection_flag", flag & F.lit(enabled))
