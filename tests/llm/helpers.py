"""Fixtures shared by the tests of the training-data operators, and plain versions of their rules."""

import re

EDGES = [
    (1, "one two three four five six seven eight nine ten", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n\x0b ", "xx"),
    (5, "one two three four five six seven eight nine ten", "en"),
    (5, "one two three four five six seven eight nine ten", "en"),
    (6, "word", "de"),
    (7, "ünïcödé 😀 text\nwith lines\nwith lines\n\n", "fr"),
    (8, "long " * 30_000, "en"),
    (None, "no id here at all", "es"),
    (-9, "x" * 5000, "en"),
]
SCHEMA = "doc_id long, text string, lang string"


def edge_documents(spark, *clashes):
    """Edge cases, with further columns whose names the operator uses itself."""
    df = spark.createDataFrame(EDGES, SCHEMA)
    for name in clashes:
        df = df.selectExpr("*", f"'clash' as `{name}`")
    return df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
