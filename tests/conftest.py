import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from threadlens.session import get_session
    s = get_session("local[*]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


ITEM_DDL = ("id bigint, type string, title string, text string, kids array<bigint>, parent bigint, "
            "time bigint, by string, score bigint, descendants bigint, url string, deleted boolean, dead boolean")


@pytest.fixture
def make_items(spark):
    """Build an item table from dicts (missing keys are null)."""
    from threadlens.schema import ITEM

    def build(rows):
        names = [f.name for f in ITEM.fields]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ITEM)
    return build
