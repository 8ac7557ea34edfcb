import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("rankspark-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def unit_index(spark):
    """The hand-computable three-article corpus."""
    from rankspark.operators.index import build_index
    rows = [(1, "lung cancer", "egfr lung trial", "egfr", ""),
            (2, "melanoma braf", "braf braf inhibitor", "braf melanoma", ""),
            (3, "flu study", "some flu text", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, title string, abstract string, keywords string, mesh string")
    return build_index(df, ("title", "abstract", "keywords", "mesh"))
