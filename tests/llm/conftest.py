import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A function that makes a documents table from texts or (doc_id, text, lang, source) rows."""

    def make(rows, extra=None):
        full = [r if isinstance(r, tuple) else (i, r, "en", "s0") for i, r in enumerate(rows)]
        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], TEXTS)
        for c in extra or ():
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
        return df

    return make
