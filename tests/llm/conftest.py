import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text[, lang]) rows, with extra columns whose names clash with results."""

    def build(rows, extra=True):
        full = [(i, t, *(r or [None]), "s", None if t is None else len(t)) for i, t, *r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for c in ("score", "lang_pred", "size", "shard", "removed_spans", "key", "n_tokens", "bucket", "component"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return build

