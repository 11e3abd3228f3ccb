import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns that names inside may clash with."""

    def make(rows):
        full = [(*r[:2], r[2] if len(r) > 2 else None, None, 0, 1, "x", 2) for r in rows]
        return spark.createDataFrame(full, DOCS + ", label int, `row` string, `a.b` int").repartition(3)

    return make


@pytest.fixture
def by_doc():
    """Rows as tuples by doc_id, in a list each."""

    def collect(df):
        out = {}
        for row in df.collect():
            out.setdefault(row["doc_id"], []).append(row)
        return out

    return collect
