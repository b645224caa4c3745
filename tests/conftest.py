import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from disputelens.session import SESSION_CONF, ensure_checkpoint_dir

    b = SparkSession.builder.master("local[4]").appName("disputelens-tests") \
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g")
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="disputelens-test-ckpt-"))
    ensure_checkpoint_dir(s)
    yield s
    from disputelens.session import drop_materialized

    drop_materialized(s)
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from disputelens.oracle.compare import duck_connect

    return duck_connect(SMALL)
