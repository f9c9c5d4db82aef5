"""Deep pages from a rank index."""

import re

import pytest
from pyspark.sql import functions as F

from seatwise.operators import roster, snapshot


@pytest.mark.parametrize(("limit", "offset"), [(10, 0), (10, 95), (50, 949), (3, 2000), (1, 99), (200, 350)])
def test_pages_of_the_index_are_those_of_the_sort(spark, limit, offset):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 9 != 0, F.concat(F.lit("U"), (F.col("id") * 7 % 50).cast("string"))).alias("usn"))
    path = snapshot.scratch_root(spark, "test-pages")
    roster.write_page_index(rows, path, block=100)
    got = roster.read_page(spark, path, limit, offset, block=100)
    want, _ = roster.page(rows, limit, offset)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert got.columns == rows.columns


def test_a_deep_page_reads_the_blocks_that_hold_it(spark):
    rows = spark.range(100_000).select("id", F.format_string("U%06d", F.col("id")).alias("usn"))
    path = snapshot.scratch_root(spark, "test-pages")
    roster.write_page_index(rows, path, block=1000)
    page = roster.read_page(spark, path, 50, 98_980, block=1000)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*>= 98\).*<= 99\)", plan)
    assert [r["id"] for r in page.collect()] == list(range(98_980, 99_030))
    assert spark.read.parquet(path).where(F.col("_block").between(98, 99)).select(F.input_file_name()).distinct().count() == 2
