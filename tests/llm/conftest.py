import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 3000
TEXTS = [
    "The cat sat on the mat.\nA second line.", None, "", "   \t\n ", "The cat sat on the mat.\nA second line.",
    "don't  we'll 's  x\n\n y \u00a0z", "Été à la plage, 12½ km — 日本語 \U0001F600!", LONG, LONG + "end", "a" * 3000, "1 2 3 !!!",
]


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and clashing column names."""
    rows = [(i, t, "xx", i, "m", 0.5) for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], "xx", 0, "m", 0.5), (0, TEXTS[0], None, None, None, None), (None, "no id", "yy", 1, "m", 0.1),
             (None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, fp long, matches string, toxicity double")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
