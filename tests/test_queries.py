"""Every query with SQL against DuckDB, every other one for rows."""

import pytest
from tests.compare import same

from dyadspark.plans import registry
from tests.conftest import DATA

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    same(registry.QUERIES[name](spark, DATA), duck.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_merge_keeps_every_concordance(spark):
    from pyspark.sql import functions as F

    from dyadspark.operators import synchrony
    from dyadspark.plans import dyads

    want = synchrony.windowed_peaks(dyads._swept(spark, DATA), of="ccc").where(F.col("peak").isNotNull()).count()
    assert registry.QUERIES["merged_methods"](spark, DATA).where(F.col("concordance_ccc").isNotNull()).count() == want > 0


def test_densified_frames_keep_every_value(spark):
    from pyspark.sql import functions as F

    from dyadspark.plans import frames

    want = frames._points(spark, DATA).where("x <> 0").select("rec", "frame").distinct().count()
    assert registry.QUERIES["densified_frames"](spark, DATA).where(F.col("x") != 0).count() == want > 0
