import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def make_words(seed, n, vocabulary=400):
    r = random.Random(seed)
    pool = random.Random(0)
    names = ["".join(pool.choices(LETTERS, k=pool.randint(2, 8))) for _ in range(vocabulary)]
    return [r.choice(names) for _ in range(n)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null columns, empty and blank texts, one very long text, copies, repeated rows, non-ASCII, and
    extra columns whose names clash with the operators' own."""
    long = " ".join(make_words(5, 60_000, 5000))
    body = " ".join(make_words(6, 80))
    rows = [
        (1, body, "en", "a", 10), (2, body, "en", "a", 10), (2, body, "en", "a", 10), (3, None, None, None, None), (4, "", "de", "b", 0), (5, " \t\n ", "de", "b", 4),
        (6, long, "en", "a", 1), (None, "null id text " * 30, "fr", None, 5), (None, None, None, None, None), (7, "été naïve ß 你好 " * 20, "fr", "c", 9), (8, "one", "en", "c", 3), (9, body + " tail words here", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["n_words", "kept", "llr", "_words", "_hashes", "_ratios", "_lines", "score", "predicted", "held_out", "topic", "shard", "slot", "_key", "_tie", "_bucket", "n_tokens", "id", "class_id", "_html", "_text", "_dedup_text", "_dedup_spans", "_dedup_key", "_gone", "_source_", "_source", "_topic", "_k_source", "_of_source", "_quality_text", "_toxicity_text", "_held", "margin_error", "fp", "words", "gram", "u", "v", "node", "copies", "weight", "_marked", "_id", "good"]
    return df.selectExpr("*", *[f"'x' AS {c}" for c in clash])


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(1, 10)] + [(None, 1, 1), (3, None, None), (2, 1, 0), (2, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
