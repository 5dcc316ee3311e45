import pytest


@pytest.fixture()
def documents(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(rows, schema)

    return make


#: Null, empty and blank texts, ties, repeated rows, a null id, marks, other scripts and a long word.
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (4, "one", "en", "b", 3),
    (5, "Ünïcödé wörds 𝒳 here and there again and again", "de", "b", 46),
    (5, "Ünïcödé wörds 𝒳 here and there again and again", "de", "b", 46),
    (None, "a text without an id that is long enough to have shingles", "en", None, 57),
    (6, "x" * 5000, "en", "c", 5000),
    (7, "<|endoftext|> \\ </s> [INST] \x02\x03", "en", "c", 30),
    (8, "the same words here and the same words there, the same words here and the same words there", "en", "c", 90),
]


@pytest.fixture()
def awkward(documents):
    return documents(AWKWARD)


@pytest.fixture()
def empty(documents):
    return documents([])


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
