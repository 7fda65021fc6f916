"""Every query of the package against its SQL in DuckDB; those without SQL run and have rows."""

from __future__ import annotations

import pytest
from conftest import SF

from corridor import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()
# relations so sparse in the smallest tables that these give nothing there: a larger size is read
SPARSE = {"bridge_pairs", "bridge_pixels", "clip_lines", "shadow_mask_clean", "missing_tiles", "texture_descriptor", "connect_coarse", "regularised_band"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, same):
    same(QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted((set(QUERIES) - set(ORACLES)) | SPARSE))
def test_rows(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.01" if name in SPARSE else SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 20 and {(r["gap_m"], r["composition"], r["reliable"]) for r in rows} == {(1.25, "vegetation", True)}


@pytest.mark.parametrize("name", ["buffer_semi_join", "class_width_surface", "nearest_road", "nearest_road_angle", "bridge_pairs", "chip_instances_bbox", "cosine_pairs"])
def test_no_nested_loop(name, spark):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pruned_scan(spark):
    plan = QUERIES["window_read"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
