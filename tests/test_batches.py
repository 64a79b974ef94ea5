"""Pages and masks that travel many to a batch."""

import itertools

import pytest
from pyspark.sql import functions as F

from pagewright.operators import folds, lettering, masks

LINES = "page_id long, ix int, x int, y int, w int, h int, text string, conf double, angle double"


@pytest.fixture
def pages(spark):
    """60 pages of one to seven boxes in batches of three rows, one page without an id; two words of each stand on a line."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    place = lambda ix: (ix % 2 * 60, ix // 2 * 100, 50, 20)
    table = [(p or None, ix, *place(ix), f"{p}.{ix}", None, 0.0) for p in range(60) for ix in range(p % 7 + 1)]
    yield spark.createDataFrame(table, LINES)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_stay_whole(pages):
    got = {}
    for r in folds.merge_words(pages).collect():
        got.setdefault(r["page_id"] or 0, set()).add((r["y"], r["text"], r["conf"]))
    lines = lambda p: {(y * 100, " ".join(f"{p}.{i}" for i in ixs), None) for y, ixs in itertools.groupby(range(p % 7 + 1), lambda i: i // 2)}
    assert got == {p: lines(p) for p in range(60)}


@pytest.mark.parametrize("rule", [folds.merge_words, folds.merge_stacked, folds.merge_columns, folds.caption_clusters, folds.collapse_duplicates, lettering.part_regions, masks.merge_boxes])
def test_pages_are_dealt_out(spark, pages, rule):
    """Few bytes are much work here, so pages must not end up in one task; nor may each cost a call of its own."""
    found = rule(pages)
    assert found.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
