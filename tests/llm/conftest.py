import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, `row` long, grp string, topic string, _text string"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one two three", "the cat sat on the mat and then the cat sat on the mat again " * 3, long, "é ñ ß 漢字 don't"]
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, None, True, 1.0, i, "g", "t", "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "a row without an id that has some words in it", None, None, 3, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf01():
    from pathlib import Path

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("driver tables not present")
    return "/root/testdata/sf0.01"
