import pytest

LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, word string, slot int, shard int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    texts = ["", None, " \n\t ", "one", "Under the MIT License: do as you like with it", LONG, "same words again and again " * 9, "tie tie tie", "tie tie tie", "ünïcode Straße ﬁn 日本語 <|endoftext|>", "a b c d e f g h i j k l m n", "A B C D E F G H I J K L M N"]
    rows = [(k, x, "en", "s", 1, 1, "w", 1, 1) for k, x in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here at all", None, None, None, None, None, None, None), (50, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
