import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from laudospark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        "laudospark-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.driver.host": "127.0.0.1",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Evaluate column builders over one text: ``one(text, c1, c2)`` gives a tuple of values."""
    from pyspark.sql import functions as F

    def run(text, *makers):
        df = spark.createDataFrame([(text,)], "t string").repartition(1)
        row = df.select(*[m(F.col("t")).alias(f"c{i}") for i, m in enumerate(makers)]).first()
        return row[0] if len(makers) == 1 else tuple(row)

    return run
