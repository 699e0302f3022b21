import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text) pairs or (doc_id, text, source) triples."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def rows_of(df, *columns):
    """Rows as tuples, sorted, null first."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))
