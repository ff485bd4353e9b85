"""Small frames for the operators of the ``llm`` folder; the session is the suite's."""

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeats, clashing names."""
    long = " ".join(f"word{k % 5003}x" for k in range(60_000))
    rows = [
        (0, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1),
        (0, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1),
        (1, None, None, None, None),
        (None, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "b", 2),
        (None, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", "en", None, 3),
        (4, "1234 5678 !!! ???", None, "c", 4),
        (5, long, "en", "a", 5),
        (6, "naïve café 日本語 <|endoftext|> a  b c\x00d", "fr", "b", 6),
    ]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, "
        "score string, kept string, row_id int, class_id int, length int, piece string"
    )
    extra = ("x", None, 1, 2, 3, None)
    return spark.createDataFrame([row + extra for row in rows], schema)
