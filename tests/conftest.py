import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from check_oracle import session
    from tidemark.schema import configure

    return configure(session())


@pytest.fixture(scope="session")
def tables(spark):
    from tidemark.plans.registry import Tables

    return Tables(spark, SF)
