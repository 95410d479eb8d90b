import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera import session

    return session.build(
        "tests",
        cpus=4,
        **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh")), "spark.sql.shuffle.partitions": "4"},
    )


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
