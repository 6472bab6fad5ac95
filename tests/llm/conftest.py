from __future__ import annotations

import random

import pytest

#: Columns beyond those of `documents` that operators might use themselves.
EXTRA = "shard string, slot string, block string, score string, rest string, id string, n string, lang_pred string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed: int, n: int = 300) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    """Texts with exact and near copies, shared passages, odd white space, empties and nulls."""
    rng, words = random.Random(seed), vocabulary(seed)
    write = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, rows = write(140), []
    for i in range(n):
        text = write(rng.choice([0, 1, 3, 5, 40, 120, 300]))
        if i % 5 == 0:
            text = f"{write(10)} {passage} {write(10)}"
        if i % 7 == 3 and rows and rows[-1][1]:
            text = rows[-1][1]
        if i % 7 == 4 and rows and rows[-1][1]:
            parts = rows[-1][1].split(" ")
            parts[len(parts) // 2] = "changed"
            text = " ".join(parts)
        rows.append((i, text, "ab"[i % 2], "s", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "a", "s", 0), (n + 2, " \n\t ", "a", "s", 4), (n + 3, "Tab\tand  two\x0bspaces\n\nİΣ é 日本語 \x1c x", "b", "s", 1), (None, write(60), "a", "s", 1), (n + 4, write(4000), "b", "s", 1)]
    return [*rows, rows[0], rows[5]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def crowded(spark, rows):
    """The same with columns of clashing names."""
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], f"{SCHEMA}, {EXTRA}").repartition(2)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
