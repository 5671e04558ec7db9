import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from orrery.session import session

    return session("4", 4)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def empty_like(spark):
    """An empty table with the columns of a test table and some whose names the operators use inside."""
    from pyspark.sql import functions as F

    def make(name, **clash):
        df = spark.read.parquet(f"{SF}/{name}.parquet").limit(0)
        for c in clash.get("extra", ()):
            df = df.withColumn(c, F.lit(None).cast("string"))
        return spark.createDataFrame([], df.schema)

    return make


@pytest.fixture(scope="session")
def clashing():
    """The table with extra columns whose names the operators use inside, and with a row of nulls."""
    from pyspark.sql import functions as F

    def make(df, *names):
        nulls = df.sparkSession.createDataFrame([tuple(None for _ in df.columns)], _nullable(df.schema))
        df = df.unionByName(nulls)
        for c in names:
            df = df.withColumn(c, F.lit("x"))
        return df

    return make


def _nullable(schema):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
