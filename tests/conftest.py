import os
import sys

import pytest
from pyspark.sql import SparkSession

TESTS = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(TESTS), TESTS]
# Senders defined in the tests run in Python workers, which import them.
os.environ["PYTHONPATH"] = os.pathsep.join([TESTS, os.environ.get("PYTHONPATH", "")])

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sluice.session import configure

    session = (SparkSession.builder.master("local[8]").appName("sluice-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g").config("spark.log.level", "ERROR")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
               .getOrCreate())
    yield configure(session)
    session.stop()
