import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Texts (in order of id) or (id, text) pairs as a documents table with its other columns,
    and columns whose names clash with the operators' own."""
    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, "en", "s", None, 1, "x", 2) for i, t in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint, "
            "row int, id string, size int").coalesce(2)
    return make
