import datetime as dt

import pytest
from pyspark.sql import functions as F

from seatwise.operators import lifecycle, snapshot, upsert
from seatwise.streaming import ingest as stream_ingest

MEM = ("id long, usn string, student_id string, full_name string, gender string, status string, "
       "department_id long, program_id long, import_id long, group_name string, bin_id long, slot_id long, "
       "created_at timestamp_ntz, is_deleted boolean")
LEDGER = "id long, file_name string, imported_at timestamp_ntz"
FACTS = "id long, member_id long, event_name string, bin_name string, group_name string"
T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


def _members(spark, rows):
    return spark.createDataFrame(rows, MEM)


def _m(i, imp=None, created=T0, bin_id=None, slot_id=None):
    return (i, f"1DS21TEST{i:03d}", f"1DS21TEST{i:03d}", f"N{i}", "Male", "Active", 1, 1, imp, None,
            bin_id, slot_id, created, False)


def test_undo_linked_members_and_cascade(spark):
    mem = _members(spark, [_m(i, imp=7) for i in range(1, 11)] + [_m(11, imp=8)])
    ledger = spark.createDataFrame([(7, "a.csv", T0), (8, "b.csv", T0)], LEDGER)
    facts = spark.createDataFrame([(1, 3, "E", "Hall", "Group A"), (2, 11, "E", "Hall", "Group A")], FACTS)
    r = lifecycle.undo_import(mem, facts, ledger, 7)
    assert [x["id"] for x in r["members"].collect()] == [11]
    assert [x["member_id"] for x in r["facts"].collect()] == [11]
    assert [x["id"] for x in r["ledger"].collect()] == [8]


def test_undo_fallbacks(spark):
    mem = _members(spark, [_m(1, created=T0 + dt.timedelta(seconds=30)),
                           _m(2, created=T0 + dt.timedelta(seconds=120)),
                           _m(3, created=T0 + dt.timedelta(seconds=121)),
                           _m(4, created=T0 - dt.timedelta(seconds=119))])
    facts = spark.createDataFrame([], FACTS)
    one = spark.createDataFrame([(5, "a.csv", T0)], LEDGER)
    # the only import and nothing linked: all members go
    assert lifecycle.undo_import(mem, facts, one, 5)["members"].count() == 0
    two = spark.createDataFrame([(5, "a.csv", T0), (6, "b.csv", T0 + dt.timedelta(days=1))], LEDGER)
    left = {x["id"] for x in lifecycle.undo_import(mem, facts, two, 5)["members"].collect()}
    assert left == {3}  # +-120 s, inclusive
    pairs = {(x["import_id"], x["member_id"]) for x in lifecycle.time_band_pairs(two, mem).collect()}
    assert pairs == {(5, 1), (5, 2), (5, 4)}


def test_delete_bin_and_slot_set_null(spark):
    mem = _members(spark, [_m(1, bin_id=1, slot_id=1), _m(2, bin_id=2, slot_id=1)])
    bins = spark.createDataFrame([(1, "A", 10, None, True), (2, "B", 10, None, True)],
                                 "id long, name string, capacity long, location string, is_active boolean")
    slots = spark.createDataFrame([(1, "S1", "", "", 1)], "id long, slot_name string, start_time string, "
                                                          "end_time string, day_number int")
    r = lifecycle.delete_bins(mem, bins, spark.createDataFrame([(1,)], "id long"))
    got = {x["id"]: x["bin_id"] for x in r["members"].collect()}
    assert got == {1: None, 2: 2} and [x["id"] for x in r["bins"].collect()] == [2]
    r = lifecycle.delete_slots(mem, slots, spark.createDataFrame([(1,)], "id long"))
    got = {x["id"]: (x["bin_id"], x["slot_id"]) for x in r["members"].collect()}
    assert got == {1: (1, None), 2: (2, None)}  # quirk Q7 kept: the bin stays
    r = lifecycle.delete_slots(mem, slots, spark.createDataFrame([(1,)], "id long"), clear_bin=True)
    assert all(x["bin_id"] is None for x in r["members"].collect())


def test_snapshot_round_trip_and_corruption(spark):
    mem = _members(spark, [_m(i) for i in range(1, 6)])
    root = snapshot.scratch_root(spark, "test-snap")
    snap = snapshot.create(spark, root, {"members": mem}, "MANUAL")
    assert [r["ok"] for r in snapshot.verify(spark, root, snap).collect()] == [True]
    changed = mem.withColumn("group_name", F.lit("Group A"))
    back = snapshot.restore(spark, root, snap, {"members": changed})["members"]
    assert back.exceptAll(mem).count() == 0 and mem.exceptAll(back).count() == 0
    lst = snapshot.list_snapshots(spark, root).collect()
    assert [r["trigger"] for r in lst] == ["PRE_ROLLBACK_AUTO_SAVE", "MANUAL"]  # newest first, history kept
    # overwrite the snapshot's files with one changed cell: verification must fail
    import glob
    part = glob.glob(f"{root.removeprefix('file:')}/data/members/0-*")
    held = [p for p in part if spark.read.parquet(p).where("group_name is null").count()][0]
    changed = spark.read.parquet(held).withColumn("gender", F.when(F.col("id") == 3, "Other").otherwise(F.col("gender"))).collect()
    spark.createDataFrame(changed, mem.schema).write.mode("overwrite").parquet(held)
    assert [(r["rows"], r["rows_now"], r["ok"]) for r in snapshot.verify(spark, root, snap).collect()] == [(5, 5, False)]
    with pytest.raises(snapshot.SnapshotError):
        snapshot.restore(spark, root, snap, {"members": mem})


def _names(root):
    import glob
    return {p for p in glob.glob(f"{root.removeprefix('file:')}/data/*/*") if "_run-" not in p}


def test_snapshots_share_unchanged_buckets(spark):
    mem = _members(spark, [_m(i) for i in range(1, 60)])
    empty = mem.limit(0)
    root = snapshot.scratch_root(spark, "test-share")
    snapshot.create(spark, root, {"members": mem, "gone": empty}, "A", bucket_rows=8)
    first = _names(root)
    assert len(first) == 8
    second = snapshot.create(spark, root, {"members": mem.repartition(3), "gone": empty}, "B", bucket_rows=8)
    assert _names(root) == first  # manifest rows only
    third = snapshot.create(spark, root, {"members": mem.withColumn("gender", F.when(F.col("id") == 7, "Other").otherwise(F.col("gender"))), "gone": empty}, "C", bucket_rows=8)
    assert len(_names(root) - first) == 1
    for snap, n in ((second, 0), (third, 1)):
        back = snapshot.read_snapshot(spark, root, snap)
        assert back["members"].exceptAll(mem).count() == n and back["members"].count() == 59
        assert back["gone"].count() == 0 and back["gone"].schema == empty.schema
    assert {(r["table"], r["ok"]) for r in snapshot.verify(spark, root, third).collect()} == {("members", True), ("gone", True)}
    assert {(r["snapshot"], r["exists"]) for r in snapshot.list_snapshots(spark, root).collect()} == {("000001", True), ("000002", True), ("000003", True)}


def test_a_crash_before_the_manifest_blocks_nothing(spark, monkeypatch):
    mem = _members(spark, [_m(i) for i in range(1, 9)])
    root = snapshot.scratch_root(spark, "test-crash")
    old = snapshot.commit(spark, root, {"members": mem}, "A")
    changed = mem.withColumn("group_name", F.lit("Group B"))
    with monkeypatch.context() as m:
        m.setattr(snapshot, "REFERENCE_SCHEMA", "broken long")
        with pytest.raises(Exception):
            snapshot.create(spark, root, {"members": changed}, "B")
    assert snapshot.current(spark, root)["members"].exceptAll(mem).count() == 0
    new = snapshot.commit(spark, root, {"members": changed}, "B")
    assert new == "000002" and snapshot.current(spark, root)["members"].exceptAll(changed).count() == 0
    saved = snapshot.restore_state(spark, root, old)
    assert snapshot.current(spark, root)["members"].exceptAll(mem).count() == 0
    assert snapshot.read_snapshot(spark, root, saved)["members"].exceptAll(changed).count() == 0
    assert [(r["action"], r["entity_id"]) for r in spark.read.parquet(f"{root}/_audit").collect()] == [("DATABASE_RESTORED", old)]
    with pytest.raises(snapshot.SnapshotError):
        snapshot.restore_state(spark, root, "000099")


def test_stream_ingest_equals_batch(spark):
    batch = spark.createDataFrame(
        [(i, f"U{(i * 7) % 13}", ["CSE", "ECE", "Mech Eng"][i % 3], "B.Tech", ["m", "f", ""][i % 3])
         for i in range(1, 41)], "row_no long, usn string, department string, program string, gender string")
    target = _members(spark, [_m(i) for i in range(1, 4)]).withColumn(
        "usn", F.concat(F.lit("U"), F.col("id").cast("string"))).withColumn("student_id", F.col("usn"))
    dept = spark.createDataFrame([(1, "CSE", "CSE")], "id long, name string, code string")
    prog = spark.createDataFrame([(1, "B.Tech", "B.TECH")], "id long, name string, code string")
    now = dt.datetime(2024, 6, 1)
    want = upsert.upsert(batch, target, dept, prog, 100, now=now)["members"]
    root = snapshot.scratch_root(spark, "test-stream")
    stream_ingest.write_uploads(batch, f"{root}/in", 3)
    stream_ingest.init_store(f"{root}/store", target, dept, prog)
    v = stream_ingest.run_ingest(spark, f"{root}/in", "row_no long, usn string, department string, "
                                 "program string, gender string", f"{root}/store", f"{root}/ckpt", 100, now=now)
    got = stream_ingest.read_version(spark, f"{root}/store", v)["members"]
    cols = [c for c in want.columns if c != "import_id"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0
