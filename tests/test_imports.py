"""The file import end to end on small uploads."""

import datetime
import hashlib

import pytest

from seatwise.operators import imports
from seatwise.sources import files

NOW = datetime.datetime(2024, 6, 1)
MEMBERS = ("id long, usn string, student_id string, student_number string, full_name string, gender string, status string, "
           "department_id long, program_id long, import_id long, is_deleted boolean, created_at timestamp_ntz")
LEDGER = ("id long, file_name string, file_hash string, total_rows long, new_records long, updated_records long, "
          "duplicate_records long, imported_at timestamp_ntz")


def _run(spark, path):
    members = spark.createDataFrame([(4, "K1", "S1", None, "Old", "Male", "Inactive", 1, 1, None, True, NOW)], MEMBERS)
    dept = spark.createDataFrame([(1, "Law", "LAW")], "id long, name string, code string")
    program = spark.createDataFrame([(1, "BA", "BA")], "id long, name string, code string")
    return imports.import_files(spark, path, members, dept, program, spark.createDataFrame([], LEDGER), 9, NOW, "t")


def test_folder_with_other_header_orders(spark, tmpdir_fresh):
    open(f"{tmpdir_fresh}/a.csv", "w").write('USN,Remark,Full Name,Dept\nk1,x,"Lee ""L"", A",Law\n,y,No Key,NA\n')
    open(f"{tmpdir_fresh}/b.csv", "w").write("Full Name,Student ID,Sex\nNew One,N7,f\nLater,s1,m\n")
    open(f"{tmpdir_fresh}/notes.txt", "w").write("not a roster\n")
    out = _run(spark, tmpdir_fresh)
    got = {r["id"]: (r["usn"], r["full_name"], r["gender"], r["status"], r["is_deleted"], r["import_id"]) for r in out["members"].collect()}
    # the last row wins: the stored member is met by its usn in the first file and by its id in the second
    assert got == {4: ("s1", "Later", "Male", "Active", False, 9), 5: ("STU_t_0002", "No Key", "Unknown", "Active", False, 9),
                   6: ("N7", "New One", "Female", "Active", False, 9)}
    row = out["ledger"].first()
    assert (row["id"], row["total_rows"], row["new_records"], row["updated_records"], row["imported_at"]) == (9, 4, 2, 2, NOW)
    assert out["audit"].first()["details"] == "4 rows: 2 new, 2 updated"


def test_one_file_keeps_its_own_hash_and_an_id_is_used_once(spark, tmpdir_fresh):
    path = f"{tmpdir_fresh}/one.csv"
    open(path, "w").write("USN,Name\nK9,Nine\n")
    out = _run(spark, path)
    row = out["ledger"].first()
    assert (row["file_name"], row["file_hash"]) == ("one.csv", hashlib.sha256(open(path, "rb").read()).hexdigest())
    with pytest.raises(ValueError):
        imports.import_files(spark, path, out["members"], out["new_dept"], out["new_program"], out["ledger"], 9, NOW)
    with pytest.raises(files.ValidationError):
        imports.read_batch(spark, f"{tmpdir_fresh}/one.xls")
