import random

import pytest
from pyspark.sql import Row

LETTERS = "abcdefghij"


def word(r, n=3):
    return "".join(r.choice(LETTERS) for _ in range(r.randint(1, n)))


def text(r, n):
    return " ".join(word(r) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, SCORE string, ids int, size string, position string, n_lines string, label string"


def rows():
    """Documents with every odd case: nulls in any column, empty, blank and very long texts, repeated rows, astral characters, clashing columns."""
    r = random.Random(3)
    texts = [text(r, r.randint(1, 60)) for _ in range(40)]
    texts += [None, "", "   \n\t", "x", "Éà 😀 中文 ſK", "word " * 30000, "y" * 30000, texts[3], texts[3], texts[4] + " tail", "A b\nc d\n\nA b"]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", "s3", "s4"][i % 5], len(t) if t is not None else None, "s", i, None, "p", None, "z"))
    out += [out[3], out[3], (None, "null id text", "en", "s1", 5, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


__all__ = ["Row", "pairs", "rows"]
