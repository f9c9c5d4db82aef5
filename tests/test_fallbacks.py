"""The size-checked local shortcuts must give the same results as the distributed paths that
take over beyond their limits; these tests force the distributed paths (limits set to 0)."""

import random

from seatwise.operators import dims, rank, seating
from tests.test_seating import BIN_SCHEMA, SLOT_SCHEMA, check_seats, member, mk_members


def test_dimension_resolve_distributed_path(spark, monkeypatch):
    monkeypatch.setattr(dims, "SMALL_SPELLINGS", 0)
    monkeypatch.setattr(rank, "SMALL_RANK_LIMIT", 0)
    existing = spark.createDataFrame([(1, "Computer Science & Engineering", "CSE")], "id long, name string, code string")
    names = spark.createDataFrame([(1, "CSE"), (2, "Computer Science Engineering"), (3, "Mechanical Eng"),
                                   (4, "mechanical   eng"), (5, "Civil")], "row_no long, name string")
    out, new = dims.resolve(names, existing)
    got = {r["row_no"]: r["dim_id"] for r in out.collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert {(r["id"], r["name"], r["code"]) for r in new.collect()} == {(2, "Mechanical Eng", "ME"), (3, "Civil", "CIVIL")}


def test_seating_distributed_offsets(spark, monkeypatch):
    monkeypatch.setattr(rank, "LOCAL_OFFSETS_LIMIT", 0)
    rnd = random.Random(21)
    rows = [member(i, f"K{rnd.randint(0, 10**6):07d}", rnd.choice([1, 2, None]), rnd.choice(["Male", "Female", None]))
            for i in range(1, 90)]
    bins = [{"id": b, "name": f"B{b}", "capacity": rnd.randint(2, 9), "is_active": True} for b in range(1, 6)]
    bins.append({"id": 99, "name": "Big", "capacity": 60, "is_active": True})
    mem = mk_members(spark, rows)
    bdf = spark.createDataFrame([(b["id"], b["name"], b["capacity"], None, True) for b in bins], BIN_SCHEMA)
    sdf = spark.createDataFrame([(s, f"S{s}", "", "", 1) for s in range(1, 4)], SLOT_SCHEMA)
    check_seats(seating.seat_slots(mem, bdf, sdf).collect(), rows, bins, 3)


def test_ordered_rank_matches_row_number_with_hot_group(spark):
    """A group holding most rows still ranks exactly like row_number over the group."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    data = [(i, "hot" if i % 4 else f"g{i % 7}", (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, g string, v long")
    got = rank.ordered_rank(df, [F.col("v"), F.col("id")], {"r": ["g"], "rank0": []}, num_partitions=6)
    want = df.select("id", (F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1).alias("w"),
                     (F.row_number().over(Window.orderBy("v", "id")) - 1).alias("w0"))
    j = got.join(want, "id")
    assert j.where((F.col("r") != F.col("w")) | (F.col("rank0") != F.col("w0"))).count() == 0
    assert j.count() == 3000


def test_bins_beyond_the_small_rank_keep_their_location(spark, monkeypatch):
    """More new bins than the driver ranks: the distributed rank must not take callers' columns (``_loc``) for its own."""
    monkeypatch.setattr(rank.small_rank, "__defaults__", (2, "rank0"))
    existing = spark.createDataFrame([(3, "Hall", 5, "Old", True)], "id long, name string, capacity long, location string, is_active boolean")
    incoming = spark.createDataFrame([(k, f"Room {k}", 10 + k, f"Block {k}") for k in range(1, 7)] + [(7, " hall ", 9, "New")],
                                     "row_no long, name string, capacity long, location string")
    got = sorted(map(tuple, dims.upsert_bins(existing, incoming).collect()))
    assert got == [(3, "Hall", 9, "Old", True)] + [(3 + k, f"Room {k}", 10 + k, f"Block {k}", True) for k in range(1, 7)]


def test_a_rank_leaves_every_column_of_its_input(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(k, *[k * 10 + j for j in range(8)]) for k in range(20)],
                               "id long, _loc long, _off long, _start long, _p long, _i long, _o0 long, _n long, _g0 long")
    for groups in ({"rank0": []}, {"rank0": ["_g0"]}, {"rank0": ["_g0"], "r": []}):
        got = rank.ordered_rank(df, [F.col("id")], groups, num_partitions=3)
        assert sorted(map(tuple, got.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
