"""Fixtures of the training-data tests; the session is the one of the folder above."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from conftest_rows import ROWS, SCHEMA  # noqa: E402

@pytest.fixture()
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture()
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
