"""Cases that once lost data: unknown imports, missing ids, mixed headers, quoted cells, blind checksums."""

import pytest

from seatwise.operators import lifecycle, report, roster, seating, snapshot, upsert
from seatwise.sources import files
from seatwise.sources import testdata as td
from tests.conftest import SF001


def test_undo_of_an_unknown_import_is_refused(spark):
    members = spark.createDataFrame([(k, None, None) for k in range(5)], "id long, import_id long, created_at timestamp_ntz")
    ledger = spark.createDataFrame([(1, None)], "id long, imported_at timestamp_ntz")
    facts = spark.createDataFrame([(1, 1)], "id long, member_id long")
    with pytest.raises(lifecycle.UnknownImportError):
        lifecycle.undo_import(members, facts, ledger, 999)
    assert lifecycle.undo_import(members, facts, ledger, 1)["members"].count() == 0


def test_missing_ids_don_t_merge_members(spark):
    batch = spark.createDataFrame([(1, "U1", "NA"), (2, "U2", "N/A"), (3, "U3", "NULL"), (4, "nan", "#N/A")], "row_no long, usn string, student_id string")
    got = {r["row_no"]: (r["usn"], r["student_id"]) for r in upsert.clean_batch(batch, "t").collect()}
    assert got == {1: ("U1", "U1"), 2: ("U2", "U2"), 3: ("U3", "U3"), 4: ("STU_t_0004", "STU_t_0004")}


def test_files_keep_their_own_headers_and_quoted_cells(spark, tmpdir_fresh):
    one, two, other = (f"{tmpdir_fresh}/{n}" for n in ("a.csv", "b.CSV", "c.txt"))
    open(one, "w").write('USN, Name\nU1,"Smith ""Jo"", A"\nU2,"two\nlines"\n')
    open(two, "w").write("Name,Extra,USN\nBob,NA,U3\n")
    open(other, "w").write("not,a,roster\n")
    got = {(r["USN"], r["Name"], r["Extra"]) for r in files.read_rosters(spark, tmpdir_fresh).collect()}
    assert got == {("U1", 'Smith "Jo", A', None), ("U2", "two\nlines", None), ("U3", "Bob", None)}
    prof = {r["source_file"].rsplit("/", 1)[1]: (r["n_rows"], r["headers"]) for r in files.profile_files(spark, tmpdir_fresh).collect()}
    assert prof == {"a.csv": (2, ["USN", "Name"]), "b.CSV": (1, ["Name", "Extra", "USN"])}
    report.write_csv(files.read_csv_rosters(spark, one).select("USN", "Name"), f"{tmpdir_fresh}/out")
    assert {r["Name"] for r in files.read_csv_rosters(spark, f"{tmpdir_fresh}/out").collect()} == {'Smith "Jo", A', "two\nlines"}


def test_checksum_sees_moved_nulls_and_equal_pairs(spark):
    def of(*rows):
        return snapshot.checksum(spark.createDataFrame(rows, "bin long, slot long")).first()["checksum"]
    assert of((3, None)) != of((None, 3))
    assert of((1, 1), (1, 1)) != of((2, 2), (2, 2))
    assert of((1, 2), (3, 4)) == of((3, 4), (1, 2))


def test_search_takes_a_backslash_as_it_is(spark):
    m = spark.createDataFrame([("a\\b", None, None, None), ("ab", None, None, None)], "usn string, student_id string, student_number string, full_name string")
    assert [r["usn"] for r in roster.search(m, "A\\b").collect()] == ["a\\b"]


def test_replaced_facts_feed_the_pivot(spark):
    m, prior = td.member(spark, SF001), td.facts(spark, SF001)
    new = seating.event_facts(m.where("group_name = 'Group A' and not is_deleted").selectExpr("id", "'Hall X' bin_name", "group_name"), ["E1", "E2"])
    facts = seating.replace_facts(prior, m, "Group A", new)
    assert facts.columns == ["id", "member_id", "event_name", "bin_name", "group_name", "created_at"]
    assert facts.count() == facts.select("id").distinct().count()
    assert report.event_pivot(m, facts, td.dept(spark, SF001), td.bins(spark, SF001)).count() > 0
