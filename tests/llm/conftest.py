from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None, **columns):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in zip(ids, texts, strict=True)]
        df = spark.createDataFrame(rows, SCHEMA)
        from pyspark.sql import functions as F

        for name, value in columns.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: Null, empty, white space only, one word, very long, a repeated text.
ODD = [None, "", " \t\n\x0b ", "one", LONG, "same words here again", "same words here again"]
