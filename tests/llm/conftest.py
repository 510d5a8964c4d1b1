import pytest


@pytest.fixture(scope="session")
def model_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def docs(spark):
    """Documents with nulls, empties, ties, repeats and a column that clashes with outputs."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "b", 0.5),
        (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "b", 0.5),
        (2, None, None, None, None),
        (3, "", "en", "a", 0.1),
        (4, " \n\t ", "fr", None, 0.2),
        (5, "Là où l'été naît, la forêt s'éveille. " * 60, "fr", "a", 0.3),
        (None, "no id here", "en", "c", 0.4),
        (7, "x" * 5000, None, "c", 0.9),
        (8, "日本語 \U0001f600 \x00 ok", "en", "b", 0.9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)
