"""Every registered query beside its DuckDB twin, on the smallest tables."""

import pytest

import compare
from shoalwater.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_twin(spark, db, name):
    said = compare.compare(spark, db, name, registry.QUERIES[name], registry.ORACLES.get(name), DATA)
    assert "DIFFER" not in said, said


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["station", "us", "run_us", "phase"] and df.count() == 1
