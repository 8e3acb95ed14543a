import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string, hits int, w int, found string, fp long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, lang), with further columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), 9.0, "x", 1, 2, "y", 3) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Null and empty texts, ties, repeated rows, a long text, other scripts.
ODD = [
    (None, "no number"),
    (3, None),
    (4, ""),
    (5, " \n\t"),
    (6, "word"),
    (7, "one two"),
    (8, "same text here twice"),
    (8, "same text here twice"),
    (9, "same text here twice"),
    (10, "漢字 и кириллица ñandú"),
    (11, "long " * 30000),
    (12, "!!! 123 ???"),
]
