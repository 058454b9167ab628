import os

import pytest

os.environ.setdefault("BENCH_CPUS", "4")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerleaf.session import local_session

    s = local_session("tests", memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


SF = "/root/testdata/sf0.001"
