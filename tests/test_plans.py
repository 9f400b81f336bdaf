"""Physical plans: pruning, pushdown, and no nested-loop or cartesian joins."""

import contextlib
import io

import pytest

from planlines.plans import registry
from planlines.plans.inputs import Inputs
from planlines.plans import catalog  # noqa: F401  (registration)

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", [
    "endpoint_pairs", "box_iou_pairs", "near_line", "positive_tiles", "image_metrics", "palette_match", "dilate", "tile_pixels", "stitch_tiles", "conf_histogram",
])
def test_no_quadratic_joins(spark, name):
    text = plan(registry.QUERIES[name](Inputs(spark, SF)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_split_selection_prunes_folders(spark):
    text = plan(registry.QUERIES["split_filter"](Inputs(spark, SF)))
    assert "PartitionFilters: [isnotnull(split" in text or "PartitionFilters: [split" in text


def test_pixel_scan_reads_only_what_it_sums(spark):
    text = plan(registry.QUERIES["pixel_scan"](Inputs(spark, SF)))
    assert "logit" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_dense_scores_are_not_shuffled_by_pixel(spark):
    text = plan(Inputs(spark, SF).scored)
    dense = text[: text.index("ObjectHashAggregate")]
    assert dense.count("Exchange") == 1 and "ShuffledHashJoin" in dense  # the spread of image rows, before pixels exist
