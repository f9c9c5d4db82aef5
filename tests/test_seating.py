import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seatwise.operators import seating, split
from seatwise.sources import testdata as td
from tests.conftest import SF01

MEMBER_SCHEMA = ("id long, usn string, student_id string, student_number string, full_name string, "
                 "gender string, status string, department_id long, program_id long, import_id long, "
                 "group_name string, bin_id long, slot_id long, is_deleted boolean")
BIN_SCHEMA = "id long, name string, capacity long, location string, is_active boolean"
SLOT_SCHEMA = "id long, slot_name string, start_time string, end_time string, day_number int"


def mk_members(spark, rows):
    cols = [c.split()[0] for c in MEMBER_SCHEMA.split(", ")]
    data = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(data, MEMBER_SCHEMA)


def member(i, usn, dept, gender, **kw):
    d = dict(id=i, usn=usn, student_id=usn, student_number=None, full_name=kw.pop("name", f"N{i}"),
             gender=gender, status="Active", department_id=dept, program_id=None, import_id=None,
             group_name=None, bin_id=None, slot_id=None, is_deleted=False)
    d.update(kw)
    return d


def check_seats(seats, rows, bins, n_slots):
    """What any right seating has: all eligible members once, even slots, bins in proportion to their
    capacity and never over it, strata spread over the bins as the bins are filled."""
    eligible = {r["id"] for r in rows if not r["is_deleted"] and r["status"] == "Active" and r["bin_id"] is None}
    assert sorted(r["id"] for r in seats) == sorted(eligible)
    capacity = {b["id"]: b["capacity"] for b in bins if b["is_active"] and b["capacity"] > 0}
    total = sum(capacity.values())
    sizes = Counter(r["slot_id"] for r in seats)
    assert len(sizes) <= n_slots and max(sizes.values()) - min(sizes[s] for s in range(1, n_slots + 1)) <= 1
    for slot, n in sizes.items():
        own = [r for r in seats if r["slot_id"] == slot]
        fill = Counter(r["bin_id"] for r in own)
        strata = Counter((r["dk"], r["gk"]) for r in own)
        cells = Counter((r["bin_id"], r["dk"], r["gk"]) for r in own)
        for b, cap in capacity.items():
            assert fill[b] <= cap and abs(fill[b] - n * cap / total) < 1
            for s, k in strata.items():
                assert abs(cells[(b, *s)] - k * fill[b] / n) < 2


def test_two_halls_share_in_proportion(spark):
    """500 members, halls of 500 and 200, one slot: exactly 357 and 143, every stratum shared alike."""
    rows = []
    for dept, men in enumerate((50, 50, 50, 70, 70), start=1):
        rows += [member(len(rows) + k, f"D{dept}-{k:03d}", dept, "Male" if k <= men else "Female") for k in range(1, 101)]
    bins = [{"id": 1, "capacity": 500, "is_active": True}, {"id": 2, "capacity": 200, "is_active": True}]
    seats = seating.seat_slots(mk_members(spark, rows), spark.createDataFrame([(1, "North", 500, None, True), (2, "South", 200, None, True)], BIN_SCHEMA),
                               spark.createDataFrame([(1, "First", "", "", 1)], SLOT_SCHEMA)).collect()
    check_seats(seats, rows, bins, 1)
    assert Counter(r["bin_id"] for r in seats) == {1: 357, 2: 143}
    assert all(70 <= n <= 73 for (b, _), n in Counter((r["bin_id"], r["dk"]) for r in seats).items() if b == 1)


def test_capacity_guard(spark):
    rows = [member(i, f"U{i:03d}", 1, "Male", group_name="Group A") for i in range(1, 26)]
    mem = mk_members(spark, rows)
    bins = spark.createDataFrame([(1, "A", 10, None, True), (2, "B", 10, None, True)], BIN_SCHEMA)
    one = spark.createDataFrame([(1, "S1", "09:00 AM", "11:00 AM", 1)], SLOT_SCHEMA)
    with pytest.raises(seating.CapacityExceededError) as ei:
        seating.seat_slots(mem, bins, one)
    assert ei.value.required_capacity == 25 and ei.value.available_capacity == 20
    two = spark.createDataFrame([(1, "S1", "09:00 AM", "11:00 AM", 1), (2, "S2", "11:00 AM", "01:00 PM", 1)],
                                SLOT_SCHEMA)
    assert seating.seat_slots(mem, bins, two).count() == 25


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_seating_properties_random(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(1, rnd.randint(40, 160)):
        rows.append(member(i, f"K{rnd.randint(0, 10**6):07d}", rnd.choice([1, 2, 3, None]),
                           rnd.choice(["Male", "Female", "Unknown", None, ""]),
                           status=rnd.choice(["Active"] * 5 + ["Inactive"]),
                           is_deleted=rnd.random() < 0.05))
    bins = [{"id": b, "name": f"B{b}", "capacity": rnd.randint(1, 9), "is_active": rnd.random() < 0.9}
            for b in range(1, rnd.randint(2, 9))]
    nslots = rnd.randint(1, 5)
    need = sum(1 for r in rows if not r["is_deleted"] and r["status"] == "Active")
    cap = sum(b["capacity"] for b in bins if b["is_active"])
    if cap * nslots < need:
        bins.append({"id": 99, "name": "Big", "capacity": need, "is_active": True})
    mem = mk_members(spark, rows)
    bdf = spark.createDataFrame([(b["id"], b["name"], b["capacity"], None, b["is_active"]) for b in bins], BIN_SCHEMA)
    sdf = spark.createDataFrame([(s, f"S{s}", "", "", 1) for s in range(1, nslots + 1)], SLOT_SCHEMA)
    check_seats(seating.seat_slots(mem, bdf, sdf).collect(), rows, bins, nslots)


def test_seat_slots_invariants_sf001(spark):
    m, b, s = td.member(spark, SF01), td.bins(spark, SF01), td.slots(spark, SF01)
    seats = seating.seat_slots(m, b, s)
    rows = seats.collect()
    elig = m.where(~F.col("is_deleted") & (F.col("status") == "Active") & F.col("bin_id").isNull()).count()
    assert len(rows) == elig and len({r["id"] for r in rows}) == elig
    cap = {r["id"]: r["capacity"] for r in b.collect()}
    fill = {}
    for r in rows:
        fill[(r["bin_id"], r["slot_id"])] = fill.get((r["bin_id"], r["slot_id"]), 0) + 1
    assert all(v <= cap[k[0]] for k, v in fill.items())


@pytest.mark.parametrize("seed", [5, 6])
def test_split_fills_the_least_filled_cohort(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(1, 120):
        rows.append(member(i, f" u{rnd.randint(0, 10**5)} ", rnd.choice([1, 2, None, 4]),
                           rnd.choice(["Male", "Female", None]),
                           group_name=rnd.choice([None] * 4 + ["Group A", "Group B", "Other"]),
                           status=rnd.choice(["Active"] * 6 + ["Inactive"]), is_deleted=rnd.random() < 0.05))
    mem = mk_members(spark, rows)
    for options in ({"gender_balance": True}, {"gender_balance": False}, {"cohorts": ("G1", "G2", "G3")}):
        cohorts = options.get("cohorts", ("Group A", "Group B"))
        out = split.split_cohorts(mem, **options).collect()
        new = {r["id"]: r["group_name"] for r in out if r["group_allocated"]}
        before = {r["id"]: r["group_name"] for r in rows}
        live = [r for r in rows if not r["is_deleted"] and r["status"] == "Active"]
        assert set(new) == {r["id"] for r in live if r["group_name"] is None} and set(new.values()) <= set(cohorts)
        assert all(r["group_name"] == before[r["id"]] for r in out if not r["group_allocated"])
        for dept in {r["department_id"] for r in live}:
            got = Counter(new[r["id"]] for r in live if r["department_id"] == dept and r["id"] in new)
            # counters begin with the department's live members of any status; without a department they begin at 0
            size = got + Counter(r["group_name"] for r in rows if not r["is_deleted"] and r["department_id"] == dept is not None and r["group_name"] in cohorts)
            assert all(size[c] <= min(size[x] for x in cohorts) + 1 for c in got)


def test_split_immutability(spark):
    rows = [member(i, f"P{i:03d}", 1 if i <= 6 else 2, "Male" if i % 2 else "Female") for i in range(1, 11)]
    mem = mk_members(spark, rows)
    first = {r["id"]: r["group_name"] for r in split.split_cohorts(mem).collect()}
    assert sorted(first.values()).count("Group A") == 5
    again = {r["id"]: r["group_name"] for r in split.split_cohorts(mem).collect()}
    assert again == first
    rows2 = [dict(r, group_name=first[r["id"]]) for r in rows] + [
        member(998, "P998", 1, "Male"), member(999, "P999", 2, "Female")]
    after = {r["id"]: r["group_name"] for r in split.split_cohorts(mk_members(spark, rows2)).collect()}
    assert all(after[i] == first[i] for i in first)
    assert after[998] is not None and after[999] is not None
