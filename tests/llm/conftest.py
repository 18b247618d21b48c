import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns whose names the operators use inside."""
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base.upper() + " ", "en"), (4, None, "en"), (5, "", None), (6, " \t\n", "en"), (7, "a b", "en"), (8, "a  B", "fr"), (9, "x " * 120_000, "en"), (None, base, "en"),
        (10, "1234 !!! 5678", "de"), (11, "un texte en français avec des accents é è à ç et des mots " * 30, "fr"), (12, "ein deutscher text mit vielen wörtern und ß und ü und ö " * 30, "de"), (13, "\x00\x07 <|endoftext|> 日本語 😀 ½ ﬁ", "ja"), (14, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("id", "key", "node", "label", "score", "row", "n", "kept", "rank", "component_id", "text_hash", "copies", "rate"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
