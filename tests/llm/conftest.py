import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) tuples, with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, copies string, shard string, __n string, `a.b` string"

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x", "y", "z", "w") for r in rows], schema)

    return make
