import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(__file__))

LONG = "long words follow one another without an end " * 3000
#: id, text: nulls, empty and very long texts, ties, repeated rows
EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four"), (6, "one two three four five six seven"),
    (7, "one two three four five six seven"), (7, "one two three four five six seven"), (7, "another text under the same id, so ties occur."),
    (None, "a text without an id. It has two sentences."), (None, None), (8, LONG), (9, LONG), (10, "ÄÖÜ ß éàç 日本語 😀\n😀"),
    (11, "x" * 5000), (12, "<|endoftext|> and <|im_end|>"), (13, "▁ marker ▁▁"),
]
#: columns whose names the operators use inside
CLASHES = ["key", "entry", "digest", "run", "part", "n", "label", "score", "size", "node", "level", "hilbert", "value"]


@pytest.fixture(scope="session")
def make(spark):
    """docs(rows, clashes=False): a table of documents; with clashes, further columns are named like inner ones."""

    def docs(rows, clashes=False):
        extra = CLASHES if clashes else []
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
             T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
             T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in extra])
        data = [
            (d, t, None if d is None else ["en", "de", None][d % 3], "src" if d is None or d % 2 else None,
             None if t is None else len(t), *["x"] * len(extra))
            for d, t in rows
        ]
        return spark.createDataFrame(data, schema)

    return docs


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def clashing(make):
    return make(EDGES, clashes=True)


@pytest.fixture(scope="session")
def no_docs(make):
    return make([])


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def corpus_rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
