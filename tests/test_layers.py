"""What a change affects, told in layers: the results of the operator over ids, slice by slice, with no id shuffled."""

import os

import pytest
from test_ends import broken  # noqa: F401

import __spark_entry__
from tessera import storage
from tessera.operators import impact, impact_layers
from tessera.sources.tables import graph_of, layers_of

SF = "/root/testdata/sf0.001"
OWNED = impact.ImpactOptions(2, ownership="owner_to_child")


def _stored(spark):
    folder = storage.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("stored-")}


def _rows(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("options", [OWNED, impact.ImpactOptions(3, kinds=("references", "calls"))])
def test_layers_affect_what_graphs_do(spark, broken, monkeypatch, options):  # noqa: F811
    both = [graph_of(spark, broken, s) for s in ("previous", "current")]
    expected = _rows(impact.affected(*both, options))
    assert {None, "attribute"} < {r.code for r in expected}
    counted = _rows(impact.summary(impact.affected(*both, options)))
    monkeypatch.setattr(storage, "SLICE", 5_000)
    layers = layers_of(spark, broken)
    assert layers.n > 1
    assert _rows(impact_layers.affected(layers, options)) == expected
    before = _stored(spark)
    assert _rows(impact_layers.summary(layers, options)) == counted
    assert _stored(spark) == before and spark.conf.get(storage._CLEANUP) == "false"


def test_steps_out_of_rows_and_provenance_are_refused(spark):
    for options in (impact.ImpactOptions(ownership="child_to_owner"), impact.ImpactOptions(provenance="direct_only")):
        with pytest.raises(ValueError):
            impact_layers.affected(layers_of(spark, SF), options)


@pytest.mark.parametrize("name", ["impact", "impact_summary"])
def test_no_step_is_shuffled_in_the_result(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert df.count() > 0
