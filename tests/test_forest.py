"""The upsert's forest over usn keys against the walk over rows in file order."""

import random

import pytest

from seatwise.operators import upsert

ROWS = "row_no long, ukey string, ikey string"
STORED = "id long, usn string, student_id string"


def walk(rows, stored):
    umap, imap = {}, {}
    for k, u, i in sorted(stored):
        if u is not None:
            umap[u] = (k, False)
        if i is not None:
            imap[i] = (k, False)
    out = {}
    for n, u, i in sorted(rows):
        umap[u] = imap[i] = out[u] = umap.get(u) or imap.get(i) or (n, True)
    return out


def forest(spark, rows, stored, **how):
    got = upsert.resolve_keys(spark.createDataFrame(rows, ROWS), spark.createDataFrame(stored, STORED), **how).collect()
    assert len(got) == len({r["ukey"] for r in got})
    return {r["ukey"]: (r["entity"], r["is_new"]) for r in got}


@pytest.mark.parametrize("seed", range(6))
def test_forest_matches_the_walk(spark, seed):
    rng = random.Random(seed)
    many = rng.choice([4, 12, 40])
    rows = [(n, f"U{rng.randrange(many)}", f"I{rng.randrange(rng.choice([2, many]))}") for n in rng.sample(range(1, 1000), 150)]
    stored = [(k, f"U{rng.randrange(many)}" if rng.random() < 0.8 else None, f"I{rng.randrange(many)}" if rng.random() < 0.8 else None) for k in range(1, 1 + seed * 2)]
    assert forest(spark, rows, stored, chunk=rng.choice([3, 50, 1 << 16])) == walk(rows, stored)


@pytest.mark.parametrize("stored", [[], [(9, None, "I0")], [(9, "U700", "I5")]])
def test_chain_of_keys_of_any_length(spark, stored):
    rows = [(n + 1, f"U{n}", f"I{n // 2}" if n % 2 else f"I{(n - 1) // 2}") for n in range(1500)]
    rows += [(2000 + n, f"U{n}", f"I{n // 2}") for n in range(0, 1500, 2)]
    assert forest(spark, rows, stored) == walk(rows, stored)
    chain = [(2 * n + d + 1, f"U{n}", f"I{n - d}") for n in range(1000) for d in (1, 0)]  # each key meets the one before
    assert forest(spark, chain, stored) == walk(chain, stored)


def test_hot_keys_spread_over_chunks(spark):
    rows = [(n, "HOT" if n % 2 else f"U{n}", "SAME") for n in range(1, 6001)]
    got = forest(spark, rows, [], chunk=64)
    assert got == walk(rows, [])
    cut = upsert.previous_keys(spark.createDataFrame(rows, ROWS), 64)
    assert cut.count() == 5999
    assert forest(spark, [], []) == {}


def test_rows_of_joined_keys_update_one_member(spark):
    batch = spark.createDataFrame([
        (1, "a1", "x", "Ann", "Arts", "P1", "1"), (2, "a2", "x", "Anna", "Law", "P2", "2"), (3, "a2", "y", None, "Arts", "P1", "3"),
        (4, "b", "y", "Bob", "Law", None, "4"), (5, "c", "s7", "Cy", "Arts", "P2", "5")],
        "row_no long, usn string, student_id string, full_name string, department string, program string, student_number string")
    target = spark.createDataFrame([(7, "old", "S7", None, "Old", 1, 1, "Male", "Inactive", 3, True)],
                                   "id long, usn string, student_id string, student_number string, full_name string, department_id long, program_id long, gender string, status string, import_id long, is_deleted boolean")
    dims = [spark.createDataFrame([(1, n, n.upper())], "id long, name string, code string") for n in ("Arts", "P1")]
    out = upsert.upsert(batch, target, *dims, import_id=9)
    got = {r["id"]: (r["usn"], r["student_id"], r["full_name"], r["student_number"], r["program_id"], r["status"]) for r in out["members"].collect()}
    # rows 1 to 4 are one new member: the last row's text, the first row's number and program
    assert got == {7: ("c", "s7", "Cy", None, 1, "Active"), 8: ("b", "y", "Bob", "1", 1, "Active")}
    assert tuple(out["ledger"].first()) == (5, 1, 4, 0)
