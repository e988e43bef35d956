import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, w string, t string, n string, row int, rank int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) with extra columns whose names clash with inner ones."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, 1, "x", "y", "z", 7, 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


LONG = "lorem ipsum dolor sit amet " * 40_000
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four"), (4, "one two three four"), (5, LONG), (6, LONG), (None, "no id here at all"), (7, "é x 😀 y z" * 3)]


@pytest.fixture(scope="session")
def edge():
    return EDGE
