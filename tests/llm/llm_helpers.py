"""Small documents with the awkward cases that every operator must define."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7))) for _ in range(n))


def frame(spark, rows, clash=()):
    """Rows of (doc_id, text) as documents; ``clash`` adds columns of those names."""
    docs = spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows], DOCS)
    for name in clash:
        docs = docs.selectExpr("*", f"'x' AS {name}")
    return docs


def empty(spark):
    return spark.createDataFrame([], DOCS)
