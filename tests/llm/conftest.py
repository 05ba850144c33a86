import random

import pytest
from llm_texts import prose


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, nulls, empties, a long text, a repeated row, a null id."""
    rng = random.Random(3)
    base = [prose(rng, n) for n in (60, 120, 200, 30, 5, 1, 400)]
    passage = prose(rng, 90)
    texts = [
        *base,
        base[1],
        base[2].replace("kadan", "KADAN", 1),
        prose(rng, 40) + "\n\n" + passage + "\n" + prose(rng, 30),
        passage + " " + prose(rng, 50),
        prose(rng, 20) + passage[100:],
        "",
        None,
        "   \n\t ",
        "é" * 700,
        "abc" * 400,
        prose(rng, 6000),
        base[2][:-30] + " end",
        "1234 5678 !!",
    ]
    rows = list(enumerate(texts))
    return [*rows, rows[1], (None, base[3]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
