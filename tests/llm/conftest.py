import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows as a table with the columns of documents, or with the given columns."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return build
