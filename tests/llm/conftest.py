import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]) rows."""
    def make(rows, extra=()):
        full = [(*r, *(None, None)[: max(0, 4 - len(r))])[:4] for r in rows]
        df = spark.createDataFrame([(i, t, a, b, len(t) if t is not None else None) for i, t, a, b in full], DOCS)
        for name in extra:
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit("clash"))
        return df.repartition(3)
    return make


@pytest.fixture(scope="session")
def tiny(spark):
    return "/root/testdata/sf0.001"
