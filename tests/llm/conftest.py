import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed_bytes string, part long, fp string, component_id string, rep string, bucket string, score string, words string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
PASSAGE = " ".join(f"passage{i} of shared words" for i in range(20))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    rows = [
        (1, "The first document has some words. " * 4 + PASSAGE + " end one", "en", "src1"),
        (2, None, None, None),
        (3, "", "en", "src2"),
        (4, " \n\t ", "fr", "src2"),
        (5, LONG, "en", "src1"),
        (6, LONG + " tail", "en", "src1"),
        (7, "Das ist ein kurzer Text mit Wörtern über Äpfel und Öl", "de", None),
        (7, "Das ist ein kurzer Text mit Wörtern über Äpfel und Öl", "de", None),
        (8, "a second text that came before. " + PASSAGE + " and after it", None, "src3"),
        (None, "no id here but a text with several words in it for all", "en", "src3"),
        (9, "x" * 5000, "en", "src1"),
        (10, "12345 67890 !!! ???", "en", "src1"),
        (10, "other text of the same id", "en", "src1"),
        (11, "日本語のテキスト、空白なし。" * 60, None, "src9"),
    ]
    return [(*r, None, "clash", 5, "a", "b", "c", "d", "e", "f") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The 1,000 documents of sf0.01."""
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
