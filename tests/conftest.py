import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the workers


@pytest.fixture(scope="session")
def spark():
    from cubelark.session import session, ship

    found = session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    found.sparkContext.setLogLevel("ERROR")
    yield ship(found)
    found.stop()


@pytest.fixture
def cube(spark):
    """A cube of shape (t, z, y, x) from a flat list of values, in the order of its axes."""
    from datetime import datetime

    from cubelark.cube import Cube

    def make(values, times, z=(0.0,), y=(-60.0, 0.0, 60.0), x=(0.0, 90.0, 180.0, 270.0), name="v", missing=None):
        cells = [(datetime.fromisoformat(t), float(a), float(b), float(c)) for t in times for a in z for b in y for c in x]
        assert len(cells) == len(values)
        df = spark.createDataFrame([(*c, v) for c, v in zip(cells, values, strict=True)], f"t timestamp_ntz, z double, y double, x double, {name} double")
        return Cube.scan(df, {a: a for a in "tzyx"}, [name], missing, origin=(name, len(values)))

    return make
