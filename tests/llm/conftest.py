import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven tall ships sail slowly past the old stone harbour wall"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, node long, rep long, score double, _id long, _n long, _tokens long, hash long"


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids and texts, empty and long texts, ties, repeated rows, and other columns with the names that operators use inside."""
    texts = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (None, PROSE), (None, None), (6, LONG), (7, "two words"), (8, "two words"), (9, "\0<|endoftext|> \x1c é漢字 😀"), (2, "another text under an id that is taken")]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "web", None, "t", 1, 2, 0.5, 99, 98, 97, 96) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
