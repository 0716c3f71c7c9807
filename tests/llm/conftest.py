"""Small tables that hold every awkward case at once."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents with text and id given; lang and source may be given too."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows, equal texts under two ids."""
    long_text = "lorem ipsum dolor sit amet " * 4000
    return make_docs([
        (1, "One two three four five six seven.", "en", "a"), (2, "", "en", "a"), (3, None, None, None),
        (None, "a text without an id", "en", None), (5, long_text, "de", "b"), (5, long_text, "de", "b"),
        (6, "One two three four five six seven.", "en", "b"), (7, " \n\t ", "fr", "a"), (8, "x", None, "a"),
        (9, "<|endoftext|> it's DON'T\x1cstop naïve ﬁn 漢字 İΣ́ a b", "en", "a"),
    ])


@pytest.fixture
def store(spark, tmp_path_factory):
    """Write tables as Parquet; returns the folder."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
