import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from scriptorium.session import build_session

    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="3", spark__ui__enabled="false", spark__driver__memory="3g", spark__sql__adaptive__coalescePartitions__enabled="true")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cells(spark):
    """Applies a function of a column to a list of lines."""
    from pyspark.sql import functions as F

    def run(f, lines):
        df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
        return [r[0] for r in df.select("line_no", f(F.col("line")).alias("out")).orderBy("line_no").select("out").collect()]

    return run


@pytest.fixture
def lines(spark):
    return lambda rows: spark.createDataFrame(list(enumerate(rows)), "line_no long, line string")
