import pytest


@pytest.fixture
def documents(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    base = "The quick brown fox jumps over the lazy dog near the river bank while seven wise owls watch them quietly from above. "
    rows = [
        (0, base * 3, "en", "a", None),
        (1, None, "en", None, 0),
        (2, "", None, "a", 0),
        (3, base * 400, "en", "a", 1),
        (4, base * 3, "en", "a", 1),
        (4, base * 3, "en", "a", 1),
        (5, "Élan vital, ça va très bien aujourd'hui; it's 42 ½ — naïve 漢字 <|endoftext|>", "fr", "b", 1),
        (6, "   \t\n ", "fr", "b", 1),
        (None, "no id here at all, just text", "en", "b", 1),
        (7, "12345 67890 !!! ???", None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as ids", "1 as start", "2.0D as score", "'y' as fingerprint", "3 as h", "4 as block", "5 as kind")
