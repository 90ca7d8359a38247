import os
import random

import pytest

from tests.llm.brute import LOWER  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, copies, and extra columns with awkward names."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one two", "en", "b"), (4, "one two", "en", "b"),
            (4, "three four five six", "de", None), (None, "a null id with some words in it", "fr", "a"), (None, None, None, "c"),
            (5, "One TWO", "en", "b"), (6, "\n\n", None, "c"), (7, "12345 !!! ???", "en", "c")]
    base = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (12, 30, 60, 200, 900, 5000)]
    i = 10
    for b in base:
        w = b.split(" ")
        for copies in range(6):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 60))):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            text = " ".join(v) if copies % 2 else "\n".join(" ".join(v[j: j + 9]) for j in range(0, len(v), 9))
            rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b", None])))
            i += 1
    rows += [(i + j, "\n".join(["a very common line of text", " ".join(rng.choice(vocab) for _ in range(8)), "  A Very common LINE of text "]), "en", "a") for j in range(40)]
    extra = [(d, t, lang, s, "x", -1, 0.5, 7) for d, t, lang, s in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, th string, n long, score double, component long").repartition(3)


@pytest.fixture(scope="session")
def rows_of(odd_docs):
    return [(r["doc_id"], r["text"]) for r in odd_docs.collect()]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same(got, want):
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
