import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, size string, key string, h int, block int, target int, row int, rid int, n int, term string, component_id int, held_out int, toxic int, kept int"
TABLES = {
    "documents": DOCUMENTS,
    "benchmark": "item_id long, text string, key string, windows int",
    "labels": "doc_id long, quality int, toxic int, text string, y int",
    "pages": "page_id long, url string, html string, digest string, payload string",
    "embeddings": "vec_id long, embedding array<float>, label int, node long, members int, id int",
}
LONG_WORD, LONG_TEXT = "a" * 120_000, " ".join(f"w{i % 977}" for i in range(60_000))

#: Nulls in every column, empty, blank and very long texts, ties, repeated rows, letters beyond ASCII.
ODD = [
    (1, "One small text, with some plain words in it.", "en", "a"),
    (1, "One small text, with some plain words in it.", "en", "a"),
    (2, "one SMALL text, with some plain words in it.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n ", "en", None),
    (None, "a text without an id but with words", "de", "c"),
    (None, None, None, None),
    (6, "É é ß 漢字 🙂 naïve mail x@y.example now", "fr", "é"),
    (7, LONG_WORD, "en", "a"),
    (8, LONG_TEXT, "en", "a"),
    (9, LONG_TEXT + " tail", "en", "b"),
    (10, "x", None, "c"),
    (11, "call +1 (743) 555-3824 or 4111 1111 1111 1111 from 10.0.0.255, not 10.0.0.256", "en", "d"),
]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Write tables (lists of rows, cut or filled with nulls to their schemas) to a new folder and return its path."""

    def make(**tables):
        path = tmp_path_factory.mktemp("sf")
        for name, of in TABLES.items():
            schema = T._parse_datatype_string(of)
            width = len(schema.fields)
            rows = [tuple(r) + (None,) * (width - len(r)) for r in tables.get(name, [])]
            spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make


@pytest.fixture(scope="session")
def odd(folder):
    return folder(documents=ODD, benchmark=[(1, "some plain words in it one two three four five six"), (2, "small text, with"), (3, None), (None, "words"), (4, "")])


@pytest.fixture(scope="session")
def nothing(folder):
    return folder()
