import random
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use themselves.
CLASHES = ("score", "shard", "piece", "spans", "entities", "key", "id", "n", "predicted", "jaccard", "label", "found", "base", "_fixed", "_tokens", "_judged", "_rewritten", "_words", "_found", "_text", "_key", "Hits", "N_Words", "a", "b")


def words(n: int, seed: int, vocabulary: int = 500) -> str:
    rng = random.Random(seed)
    table = random.Random(1)
    known = ["".join(table.choices(string.ascii_lowercase, k=table.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(known) for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text)"""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, clashing columns."""
    from pyspark.sql import functions as F

    rows = [(1, "a few plain words here for once"), (1, "a few plain words here for once"), (2, ""), (3, None), (None, "no id here but words all the same"), (None, None), (4, words(30_000, 4)), (5, "x" * 50_000), (6, " \t\n "), (7, "é日本語 \U0001f600 words \x00 \x1c end"), (8, words(200, 8)), (9, words(200, 8)), (-3, "negative id")]
    df = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") > 4, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}
