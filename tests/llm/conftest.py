import pytest


@pytest.fixture
def docs(spark):
    """A documents table with columns whose names clash with internal ones."""
    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F
        frame = spark.createDataFrame(rows, schema)
        return frame.withColumns({c: F.lit("x") for c in ("id", "seed", "part", "bucket", "words", "group", "label", "length")})
    return make
