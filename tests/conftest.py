import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablemend.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("8", shuffle_partitions=4, app="tests")


@pytest.fixture(scope="session")
def fixture_rows(spark):
    from pyspark.sql import functions as F

    from tablemend.sources import files
    from tests.fixtures import FILES

    texts = spark.createDataFrame(list(FILES.items()), "file_id string, text string")
    rows = files.rows_from_lines(files.explode_text(texts, "file_id", F.col("text")))
    return files.with_width(rows).cache()
