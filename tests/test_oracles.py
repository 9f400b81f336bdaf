"""Registered queries against their SQL on the smallest data folder.

A spread of quick queries by default; ``PLANLINES_FULL=1`` runs every one.
"""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = [
    "coco_scan", "split_summary", "endpoint_pairs", "merged_edges", "normalize_detections", "conf_rank", "id_batches", "nms",
    "inner_box", "near_line", "near_line_v1", "near_line_v2", "tile_grid", "positive_tiles", "gt_mask", "dilate", "tile_pixels",
    "augment_tiles", "stitch_tiles", "image_metrics", "dice", "length_ratio_pixel", "channel_stats", "bce_dice", "lovasz_hinge",
    "symbol_features", "score_linear", "relabel_audit", "roc_auc", "pr_at_targets", "pending_images", "history_report", "stream_ingest",
    "coco_document_scan", "skeleton", "eval_report", "radius_sweep_loops", "stream_resets", "payload_lists",
]
NAMES = list(entry.queries()) if os.environ.get("PLANLINES_FULL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, message


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "dice" in df.columns
