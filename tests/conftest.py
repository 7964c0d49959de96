import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from minespark.session import get_spark

    return get_spark("tests", cpus=4, memory="4g", **{"spark.sql.shuffle.partitions": "4"})
