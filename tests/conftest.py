import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loreloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a Column -> Column function on a list of strings."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]

    return run
