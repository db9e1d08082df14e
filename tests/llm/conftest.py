import pytest
from pyspark.sql import SparkSession

TEXT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark: SparkSession):
    """Makes a documents table; a row is an id and a text, or all five columns."""
    def make(*rows):
        full = [(*r, "en", "src1", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, TEXT)

    return make


LONG = "alpha beta gamma delta " * 30_000


@pytest.fixture
def odd(documents):
    """Nulls in every column, empty and very long texts, repeated rows, and clashing extra columns."""
    rows = documents(
        (1, None), (2, ""), (3, "one two three four five six seven eight nine ten eleven twelve"),
        (3, "one two three four five six seven eight nine ten eleven twelve"), (None, "one two three four five six"),
        (5, LONG), (6, None, None, None, None), (7, " \n\t "), (8, "tiny"),
    )
    extra = {n: rows["doc_id"] for n in ("rank", "node", "key", "bucket", "part", "weights", "arc", "place", "taken", "domain_", "band", "spans")}
    return rows.withColumns(extra)
