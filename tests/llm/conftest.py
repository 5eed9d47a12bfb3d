import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture
def frame(spark):
    """documents of (doc_id, text) rows or of texts alone."""

    def make(rows, schema=SCHEMA):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, "s") if len(r) == 2 else r for r in rows], schema).repartition(3)

    return make


@pytest.fixture
def run_op(spark, tmp_path):
    """Writes tables to a folder and runs a query of the subpackage over them."""

    def run(name, **tables):
        from lectern.llm import queries

        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return queries.QUERIES[name](spark, str(tmp_path))

    return run
