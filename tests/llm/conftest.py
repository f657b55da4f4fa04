import pytest


@pytest.fixture
def make(spark):
    """documents from texts (or (doc_id, text)), with columns whose names clash with those of results."""

    def build(rows, **more):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(d, t, "x", "s", 0) for d, t in rows], "doc_id long, text string, fingerprint string, start string, n_chars long")

    return build


@pytest.fixture
def small():
    """Edge cases that every operator meets: null, empty, white space, very long, ties and repeats."""
    return [None, "", " \n\t ", "a", "word " * 40_000, "same text here", "same text here", "Größe ça ñ 漢字 😀", "x" * 30_000]
