"""Lexical scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(tokens: Column, query: list[str]) -> Column:
    """All query lexemes occur; an empty query matches nothing."""
    if not query:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, query)), tokens)) == 0


def occurrences(tokens: Column, lexeme: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == lexeme))


def cover_density(query: list[str]):
    """Cover-density rank as a column function of tokens. One lexeme: 0.1 for each occurrence. Several: each
    shortest stretch that has them all adds 0.1 times their number over one more than the other words in it."""
    wanted = set(query)
    if len(wanted) <= 1:
        return lambda tokens: (occurrences(tokens, next(iter(wanted))) * 0.1 if wanted else F.lit(0.0))

    @F.pandas_udf("double")
    def rank(tokens: pd.Series) -> pd.Series:
        def one(these) -> float:
            last: dict[str, int] = {}
            score, start = 0.0, -1
            for i, t in enumerate(() if these is None else these):
                if t in wanted:
                    last[t] = i
                    if len(last) == len(wanted) and (first := min(last.values())) > start:
                        start = first
                        score += 0.1 * len(wanted) / (1 + i - first + 1 - len(wanted))
            return score

        return tokens.map(one)

    return rank


def trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def word_similarity(query: str):
    """Largest share of the query's trigrams found in any run of a text's trigrams, less the run's others:
    shared / (query trigrams), the run as long as the query's at most."""
    asked = {g for w in query.split() for g in trigrams(w)}

    @F.pandas_udf("double")
    def similarity(tokens: pd.Series) -> pd.Series:
        def one(these) -> float:
            grams = [g for w in (() if these is None else these) for g in trigrams(w)]
            n, best = len(asked), 0
            if not n:
                return 0.0
            count: dict[str, int] = {}
            for i, g in enumerate(grams):
                if g in asked:
                    count[g] = count.get(g, 0) + 1
                if i >= n and (old := grams[i - n]) in count:
                    count[old] -= 1
                    if not count[old]:
                        del count[old]
                best = max(best, len(count))
            return best / n

        return tokens.map(one)

    return similarity
