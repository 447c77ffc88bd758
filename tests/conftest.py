import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sluice.session import StageStore, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "sluice-tests", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def store(spark, tmp_path):
    return StageStore(spark, str(tmp_path))


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
