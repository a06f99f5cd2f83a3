import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers unpickle the tests' scorers by module name.
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.path.dirname(HERE), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from causeway.plans.session import local_session

    # Spark reads this setting when it starts.
    SparkSession.builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    session = local_session(cores=4, shuffle_partitions=4)
    yield session
    session.stop()
