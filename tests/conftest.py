import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tenderlake.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    from tenderlake.plans.views import Views

    return Views(spark, SMALL)


@pytest.fixture
def values(spark):
    """Evaluate a column expression over literal rows of one column `x`."""

    def run(expr, inputs, type_="string"):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {type_}")
        return [r[0] for r in df.orderBy("i").select(expr).collect()]

    return run


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
