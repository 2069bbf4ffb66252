import pytest

LONG = ("Überall wächst " + "a" * 3000 + " and   so\n\n on, it's 42nd;  ") * 60
AWKWARD = [
    (1, "Hello world, hello world.\nHello  world,\thello world.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t  ", "de"),
    (5, LONG, "de"),
    (6, "naïve café \u00a0\u2003 x\u0301\u0301 <|endoftext|> 12.5%% '' 'll \x1c\x85 \U0001f600\U0001f600 漢字漢字", "fr"),
    (6, "naïve café \u00a0\u2003 x\u0301\u0301 <|endoftext|> 12.5%% '' 'll \x1c\x85 \U0001f600\U0001f600 漢字漢字", "fr"),
    (None, "no id here, only some words " * 12, "es"),
    (7, "one two three four five six seven eight nine ten eleven " * 4, "en"),
    (8, "x" * 150_000, "en"),
    (9, " " * 5000 + "\n" * 300 + "z", None),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty and long ones, repeated rows, and extra columns named like results."""
    rows = [(i, t, l, "s", 1, "clash", 0.5) for i, t, l in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, word string, score double")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
