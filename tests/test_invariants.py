"""Invariants: results do not depend on input order or partitioning; seats never exceed capacity."""

import datetime as dt

from pyspark.sql import functions as F

from seatwise.operators import seating, split, upsert
from seatwise.sources import testdata as td
from tests.conftest import SF01


def _same(a, b, cols):
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_split_and_seating_ignore_input_order(spark):
    m = td.member(spark, SF01)
    shuffled = m.repartition(7, F.rand(3)).sortWithinPartitions(F.rand(5))
    assert _same(split.split_cohorts(m), split.split_cohorts(shuffled), ["id", "group_name"])
    b, s = td.bins(spark, SF01), td.slots(spark, SF01)
    b_shuf = b.repartition(3, F.rand(1))
    assert _same(seating.seat_slots(m, b, s), seating.seat_slots(shuffled, b_shuf, s), ["id", "bin_id", "slot_id"])


def test_upsert_ignores_input_order(spark):
    b = td.batch(spark, SF01)
    t = td.member(spark, SF01)
    d, p = td.dept(spark, SF01), td.program(spark, SF01)
    now = dt.datetime(2024, 6, 1)
    a = upsert.upsert(b, t, d, p, 1, now=now)["members"]
    c = upsert.upsert(b.repartition(5, F.rand(2)), t.repartition(4, F.rand(4)), d, p, 1, now=now)["members"]
    assert _same(a, c, a.columns)


def test_cohort_seating_totals(spark):
    m = td.member(spark, SF01)
    v = td.bins(spark, SF01).where("is_active").select(
        (F.col("id") - 1).alias("ord"), "name", "capacity")
    seats = seating.seat_cohort(m, v, "Group A")
    n = m.where(~F.col("is_deleted") & (F.col("status") == "Active") & (F.col("group_name") == "Group A")).count()
    assert seats.count() == n and seats.select("id").distinct().count() == n
