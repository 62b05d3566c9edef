"""Small document frames."""

import pytest
from pyspark.sql.types import LongType, StringType, StructType

SCHEMA = StructType().add("doc_id", LongType()).add("text", StringType()).add("lang", StringType()).add("source", StringType()).add("n_chars", LongType())


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of texts, or of (id, text) pairs."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, None, "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make
