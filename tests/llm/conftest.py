import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, k1 string, _t int, `bucket` int"


@pytest.fixture
def docs_of(spark):
    """documents with extra columns whose names clash with internal ones."""

    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(parts)

    return make
