"""Every query of the registry against its SQL on the smallest tables; those without SQL run and give rows."""

import inspect
import os

import pytest

from readq.operators import ml
from readq.plans import registry
from tests.compare import differences

SMALL = os.environ.get("READQ_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert differences(registry.queries()[name], registry.oracle_sql()[name], spark, SMALL) == ""


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).count() >= 0


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert registry.flagship(spark, SMALL).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_feature_probe_fits_all_trees(spark, monkeypatch):
    fit, asked = ml.boosted_trees, []

    def short(*args, **kwargs):
        b = inspect.signature(fit).bind(*args, **kwargs)
        b.apply_defaults()
        asked.append(tuple(b.arguments[k] for k in ("trees", "depth", "rate", "seed")))
        return fit(b.arguments["df"], trees=1, depth=1)

    monkeypatch.setattr(ml, "boosted_trees", short)
    assert registry.queries()["feature_probe"](spark, SMALL).count() == 6
    assert asked == [(300, 5, 0.1, 42)]


@needs_data
def test_vector_probe_reports_on_rows_held_out(spark, monkeypatch):
    fit, seen = ml.linear_probe, []

    def noted(*args, **kwargs):
        b = inspect.signature(fit).bind(*args, **kwargs)
        b.apply_defaults()
        seen.append((b.arguments["df"].count(), b.arguments["rounds"]))
        return fit(*args, **kwargs)

    monkeypatch.setattr(ml, "linear_probe", noted)
    support = {r["class"]: r["support"] for r in registry.queries()["vector_probe"](spark, SMALL).collect()}["macro"]
    (fitted, rounds), rows = seen[0], spark.read.parquet(f"{SMALL}/embeddings.parquet").where("label IS NOT NULL").count()
    assert rounds == 300 and 0 < support < fitted and support + fitted == rows
