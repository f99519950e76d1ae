import pytest


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture
def documents(spark):
    """Builds documents with an extra column; texts may be None."""

    def build(texts, first=0, sources=None):
        rows = [(first + k, t, "en", (sources or ["src0"])[k % len(sources or ["src0"])], len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return build
