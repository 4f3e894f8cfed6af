"""Plan shape: no quadratic join nodes, pruned scans, pushed filters, bounded windows."""

import re

import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
SPATIAL = [
    "j01_parcel_overlaps", "j02_intersection_area", "j03_water_overlaps", "j04_neighbour_conflicts", "j05_flagged_gaps", "j06_point_in_polygon", "j08_nearest_polyline",
    "j09_road_frontage", "j10_adjacent_boundaries", "j11_perimeter_support", "j12_edge_support", "j13_water_contact", "j14_road_intersections", "j17_class_conflicts",
    "j18_anchor_filter", "j19_settlement_field_filter", "j23_parcels_within_radius", "m22_snap_vertices", "p11_bbox_iou",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPATIAL)
def test_no_quadratic_join(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name,columns", [("n01_scope_features", {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"}), ("w05_first_verification", {"event_id", "ts", "user_id", "event_type"})])
def test_scan_reads_only_needed_columns(spark, small, name, columns):
    text = plan(QUERIES[name](spark, small))
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} <= columns


def test_filters_reach_the_scan(spark, small):
    text = plan(QUERIES["l09_lookups"](spark, small))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(user_id,42\)", text)


@pytest.mark.parametrize("name", ["w12_cap_per_class", "l04_activity_feed", "l07_top_rejections", "l01_search_parcels"])
def test_rank_limits_are_pushed_below_the_shuffle(spark, small, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, small))


def test_no_python_in_relational_queries(spark, small):
    for name in ("a02_sliver_report", "j01_parcel_overlaps", "m09_validate_parcels", "w01_append_versions", "l01_search_parcels", "r05_sobel"):
        text = plan(QUERIES[name](spark, small))
        assert "ArrowEvalPython" not in text and "MapInPandas" not in text and "BatchEvalPython" not in text


def test_checkpoint_folder_is_the_sessions(spark):
    from cadastre.session import ensure_checkpoint_dir

    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == first and first


def test_pixels_are_never_broadcast(spark, small):
    """The estimate of exploded pixels is that of their file, so a join left to it sends them through the driver."""
    text = plan(QUERIES["r11_component_spine"](spark, small))
    assert "BroadcastExchange" not in text and "SortMergeJoin" in text
