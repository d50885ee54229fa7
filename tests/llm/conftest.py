import pytest

from llm_rows import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text, source) rows."""

    def make(rows, partitions=3):
        full = [(d, t, "en", s, len(t) if t is not None else None) for d, t, s in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows, a hot source and copies."""
    long = prose(1, 6_000)
    near = prose(2, 300)
    rows = [
        (1, None, "a"), (2, "", "a"), (None, "no id at all but some words in it", None), (None, "no id at all but some words in it", None),
        (None, None, None), (3, "   \n\t ", None), (4, long, "a"), (5, long, "a"), (6, "x" * 5_000, "b"), (6, "x" * 5_000, "b"),
        (7, near, "c"), (8, near + " tail", "c"), (9, "one", "c"), (9, "two", "c"), (10, "a b c d e " * 50, "a"), (11, "\x00\x1c é☃ 𝔘", "é"),
    ]
    return rows + [(100 + i, prose(50 + i % 7, 40), "hot") for i in range(20)]
