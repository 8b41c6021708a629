import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessella.session import session

    shared = str(tmp_path_factory.mktemp("checkpoints"))
    found = session("local[4]", 4, **{"spark.checkpoint.dir": shared, "spark.driver.memory": "4g"})
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
