import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from funnelworks.session import get_spark
    scratch = tempfile.mkdtemp(prefix="funnelworks-tests-")
    s = get_spark("local[4]", 4, extra_conf={"spark.driver.memory": "8g", "spark.local.dir": scratch})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="funnelworks-t-")
