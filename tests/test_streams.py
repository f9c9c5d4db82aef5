"""Stream state: deltas that follow the micro-batch, replays, new bases; counts with members that move and leave."""

import datetime as dt
import os
import random
from collections import Counter

from seatwise.operators import snapshot, upsert
from seatwise.streaming import ingest, kpi

MEMBER = ("id long, usn string, student_id string, student_number string, full_name string, gender string, status string, department_id long, program_id long, "
          "import_id long, group_name string, bin_id long, slot_id long, created_at timestamp_ntz, is_deleted boolean")
NOW = dt.datetime(2024, 6, 1)
BATCH = "row_no long, usn string, department string, program string"


def _store(spark, n):
    members = spark.createDataFrame([(k, f"U{k}", f"U{k}", None, f"M{k}", "Male", "Active", 1, 1, None, None, None, None, NOW, False) for k in range(1, n + 1)], MEMBER)
    dims = [spark.createDataFrame([(1, x, x.upper())], "id long, name string, code string") for x in ("CSE", "BT")]
    root = snapshot.scratch_root(spark, "test-deltas")
    ingest.init_store(root, members, *dims)
    return root


def _apply(spark, root, epoch, rows):
    cur = ingest.read_version(spark, root, ingest.latest_version(spark, root, at_most=epoch))
    res = upsert.upsert(spark.createDataFrame(rows, BATCH), cur["members"], cur["dept"], cur["program"], import_id=100 + epoch, now=NOW)
    want = sorted(map(tuple, res["members"].collect()))
    ingest.write_changes(spark, root, epoch, {"members": res["members"].where(f"import_id = {100 + epoch}"), "dept": res["new_dept"], "program": res["new_program"]})
    return want


def test_a_small_batch_writes_a_small_delta_and_a_replay_changes_nothing(spark):
    root = _store(spark, 400)
    local = root.removeprefix("file:")
    rows = [(1, "U7", "CSE", "BT"), (2, "u7", "Law School", "BT"), (3, "new1", "CSE", "BT")]
    want = _apply(spark, root, 0, rows)
    assert spark.read.parquet(f"{root}/members/delta=1").count() == 2 and not os.path.exists(f"{local}/members/base=1")
    assert sorted(map(tuple, ingest.read_version(spark, root, 1)["members"].collect())) == want and len(want) == 401
    assert _apply(spark, root, 0, rows) == want  # the same micro-batch again
    assert sorted(map(tuple, ingest.read_version(spark, root, 1)["members"].collect())) == want
    assert ingest.read_version(spark, root, 1)["dept"].count() == 2
    want = _apply(spark, root, 1, [(1, "U7", "CSE", "BT"), (2, "new1", "Law School", "BT"), (3, "new2", "CSE", "BT")])
    got = ingest.read_version(spark, root, 2)
    assert sorted(map(tuple, got["members"].collect())) == want and len(want) == 402 and got["dept"].count() == 2
    assert sorted(r["id"] for r in got["members"].collect()) == list(range(1, 403))


def test_grown_deltas_become_a_base(spark):
    root = _store(spark, 20)
    _apply(spark, root, 0, [(k, f"U{k}", "CSE", "BT") for k in range(1, 4)])
    want = _apply(spark, root, 1, [(k, f"V{k}", "CSE", "BT") for k in range(1, 6)])
    v = ingest._version(spark, root, 2)
    assert (v["base"], v["deltas"], v["base_rows"]) == (2, [], 25)
    assert sorted(map(tuple, ingest.read_version(spark, root, 2)["members"].collect())) == want
    assert ingest.read_version(spark, root, 1)["members"].count() == 20  # older versions still read


def test_counts_follow_members_that_move_and_leave(spark):
    rng = random.Random(6)
    log = [(k, rng.randrange(40), rng.choice(["A", "B", "C", None, ""])) for k in range(300)]
    root = snapshot.scratch_root(spark, "test-changes")
    schema = "turn long, member long, label string"
    last: dict = {}
    for part, lo in enumerate(range(0, 300, 100)):
        rows = log[lo:lo + 100]
        rng.shuffle(rows)
        if part:
            rows.append(log[lo - 50])  # an old row arrives again
        spark.createDataFrame(rows + [(None, 1, "A"), (7, None, "A")], schema).coalesce(1).write.parquet(f"{root}/log/part_{part}")
        v = kpi.changes_stream(spark, f"{root}/log/*", schema, "member", "label", "turn", f"{root}/sink", f"{root}/ckpt", 1)
        for t, m, label in sorted(log[:lo + 100]):
            last[m] = label
        got = {r["label"]: r["n"] for r in spark.read.parquet(f"{root}/sink/v={v}").collect()}
        assert got == dict(Counter(x for x in last.values() if x)), part
