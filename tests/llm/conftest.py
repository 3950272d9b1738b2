import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from (doc_id, text, lang, source) rows, shorter ones filled with nulls, in 3 partitions,
    with an extra column whose name the operators use themselves."""

    def make(*rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], SCHEMA)
        return df.selectExpr("*", "'clash' as size", "1 as rid", "0 as copies", "cast(null as void) as row").repartition(3)

    return make


EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "same text of several words here", "en", "b"),
    (5, "same text of several words here", "en", "b"), (5, "same text of several words here", "en", "b"), (None, "no id but a text of words", "de", None),
    (6, "ümlaut 😀   words\x00 end", None, "ß"), (7, "x" * 30_000, "en", "a"), (8, "word " * 20_000, "en", "a"),
]


@pytest.fixture(scope="session")
def edge(docs):
    return docs(*EDGE)


@pytest.fixture(scope="session")
def empty(docs, edge):
    return edge.limit(0)
