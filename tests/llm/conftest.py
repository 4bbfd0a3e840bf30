import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return {
        name: spark.read.parquet(f"{SMALL}/{name}.parquet").cache()
        for name in ("documents", "pages", "benchmark", "labels")
    }


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small["documents"].select("doc_id", "text").collect()}
