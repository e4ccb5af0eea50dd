import os

import pytest

from oracles import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_pairs_hold_every_item_of_every_order(spark):
    orders, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    every = orders.join(items, orders.o_orderkey == items.l_orderkey).select("o_custkey", "l_suppkey").distinct()
    assert sorted(map(tuple, fx.spark_view(spark, SF, "synth_pairs").collect())) == sorted(map(tuple, every.collect()))
