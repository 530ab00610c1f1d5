import pytest

#: Rows that every operator must take: nulls, empty and long texts, equal texts, repeated rows, other columns of clashing names.
ROWS = [
    (1, "The cat sat on the mat and the dog sat on the log by the river bank today.", "en"),
    (2, "The cat sat on the mat and the dog sat on the log by the river bank today.", "en"),
    (3, "Die Katze sitzt auf der Matte und der Hund sitzt auf dem Baumstamm am Fluss heute.", "de"),
    (4, None, "en"),
    (5, "", None),
    (6, "%%% ### !!! 123", "en"),
    (7, "word " * 60_000, "en"),
    (None, "A text without an id, but with words enough for windows of ten words or so.", "en"),
    (8, "é日本語 </s>[INST] it's <|endoftext|> \x85 fine", None),
    (8, "é日本語 </s>[INST] it's <|endoftext|> \x85 fine", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, "x", 0.5, 3, "k") for i, t, lang in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, shard int, key string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
