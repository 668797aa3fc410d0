import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from catalog.check import session  # noqa: E402


# Fixture tables are tiny: two partitions, and no time spent on compiling each plan.
FIXTURE_CONF = {
    "spark.sql.shuffle.partitions": "2",
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN",
}


@pytest.fixture(scope="session")
def spark():
    return session(8, FIXTURE_CONF)


@pytest.fixture
def edges_of(spark):
    def make(pairs):
        return spark.createDataFrame(list(pairs), "src bigint, dst bigint")

    return make


@pytest.fixture
def ids_of(spark):
    def make(ids):
        return spark.createDataFrame([(i,) for i in ids], "id bigint")

    return make
