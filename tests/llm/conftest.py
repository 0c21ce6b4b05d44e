import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of (doc_id, text[, source]) as a documents table with an extra column of a clashing name."""

    def make(rows):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        return df.withColumn("kept", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("size", F.lit(3)).withColumn("tag", F.lit(4))

    return make
