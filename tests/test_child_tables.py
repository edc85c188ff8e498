"""The flat tables of all three sources hold what p3_found places."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_items_and_leaves_of_all_sources(spark):
    q = e.queries()
    items, leaves, places = (q[n](spark, DATA).cache() for n in ("p3_items", "p3_leaves", "p3_found"))
    keys = ["source_table", "parent_id", "item_no"]
    assert {r.source_table for r in items.select("source_table").distinct().collect()} == {"runs", "spec_results", "analysis_results"}
    assert items.where("json is null").count() == 0 and leaves.where("leaf is null or leaf = ''").count() == 0
    both = items.select(*keys, F.lit(-1).alias("leaf_no")).unionByName(leaves.select(*keys, "leaf_no"))
    assert both.exceptAll(places).count() == 0 and places.exceptAll(both).count() == 0
