import pytest


def texts_frame(spark, rows, extra=True):
    """documents-like rows (doc_id, text, lang, source), with columns whose names clash with outputs."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 as score", "'x' as kept", "2 as size") if extra else df


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows, extra=True: texts_frame(spark, rows, extra)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
