"""Roster files: CSV records over byte ranges, workbooks in and out, digests."""

import csv
import hashlib
import io
import os
import random
import zipfile
from unittest import mock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seatwise.operators import imports, upsert
from seatwise.sources import files, records, workbook


@pytest.fixture()
def small_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows_of(text):
    return [r for r in csv.reader(io.StringIO(text.replace("\r\n", "\n"), newline="")) if r]


@pytest.mark.parametrize(("seed", "broadcast"), [(1, 1000), (2, 1000), (3, 0), (4, 1000)])
def test_records_of_byte_ranges(spark, tmpdir_fresh, small_ranges, seed, broadcast):
    rng = random.Random(seed)
    cells = ["x", "", '"a,b"', '"two\nlines"', '"say ""hi"""', '"' + "long\n" * rng.randrange(80) + '"', 'stray " quote', "é\U0001f600", '""', '"\n\n"', "7"]
    want = {}
    for n in range(5):
        end = rng.choice(["\n", "\r\n"])
        lines = ["a,b"] + [f"{k}:{rng.choice(cells)},{rng.choice(cells)}" if rng.random() < 0.3 else f"{rng.choice(cells)},{rng.choice(cells)}" for k in range(rng.randrange(1, 40))]
        text = end.join(lines) + rng.choice(["", end, end + end])
        open(f"{tmpdir_fresh}/f{n}.csv", "w", newline="").write(text)
        want[f"f{n}.csv"] = rows_of(text)
    got = {}
    found = records.csv_records(spark, tmpdir_fresh, True, broadcast).orderBy("file", "line").collect()
    assert len({(r["file"], r["line"]) for r in found}) == len(found)
    for r in found:
        got.setdefault(r["file"].rsplit("/", 1)[1], []).extend(rows_of(r["text"]))
    assert got == want
    assert spark.read.text(tmpdir_fresh).rdd.getNumPartitions() > 5


@settings(max_examples=200, deadline=None)
@given(st.text('",a\n', max_size=60), st.booleans())
def test_state_of_a_text_is_that_of_its_lines(text, inside):
    state = inside
    for line in text.split("\n"):
        state = records.inside_after(line, state)
    machine, at_start, k = inside, not inside, 0  # character by character
    while k < len(text):
        c = text[k]
        if machine:
            if c == '"' and text[k + 1:k + 2] == '"':
                k += 1
            elif c == '"':
                machine = False
        elif c == '"' and at_start:
            machine = True
        at_start = not machine and c in ",\n"
        k += 1
    assert state == machine


def test_state_before_a_range_follows_from_those_before(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for f in range(20):
        state = False
        for b in range(rng.randrange(1, 15)):
            want[f"f{f}", b] = state
            out, in_ = rng.choice([(False, True)] * 4 + [(True, False), (True, True), (False, False)])
            rows.append((f"f{f}", b, out, in_))
            state = in_ if state else out
    got = records.begins_inside(spark.createDataFrame(rows, "file string, block long, from_out boolean, from_in boolean")).collect()
    assert {(r["file"], r["block"]): r["inside"] for r in got} == want


def test_a_record_with_other_cells_is_an_error(spark, tmpdir_fresh):
    open(f"{tmpdir_fresh}/a.csv", "w").write("a,b\n1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_rosters(spark, tmpdir_fresh).collect()


SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def foreign_book(path):
    """A workbook as other programs write it: shared strings with runs, styles, gaps, an absolute target, the other calendar."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{rel}"><workbookPr date1904="1"/><sheets><sheet name="Roster" sheetId="3" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}"><si><t>USN Number</t></si><si><r><t>Student </t></r><r><t xml:space="preserve">Name</t></r><rPh sb="0" eb="1"><t>hint</t></rPh></si>'
                                '<si><t>A_x000D_&amp;_x005F_x000D_</t></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{SHEET}"><numFmts count="3"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/>'
                         '<numFmt numFmtId="166" formatCode="[Red]0"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>'
                         '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="22"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="21"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f'<worksheet xmlns="{SHEET}"><sheetData><row r="2"/><row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c t="inlineStr"><is><t>When</t></is></c>'
                               '<c t="str"><v>F</v></c></row><row r="9"><c r="A9"><v>1.0E3</v></c><c r="C9" t="s"><v>2</v></c><c r="D9" s="1"><v>366</v></c><c r="E9" t="b"><v>1</v></c></row>'
                               '<row r="10"><c r="D10" s="2"><v>366.5</v></c><c r="C10" t="e"><v>#N/A</v></c><c r="A10" s="3"><v>0.1</v></c></row>'
                               '<row r="11"><c r="A11" s="4"><v>12</v></c><c r="D11" s="5"><v>0.25</v></c><c r="E11" t="n"/></row></sheetData></worksheet>'}
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_a_foreign_workbook_reads_like_its_csv(spark, tmpdir_fresh):
    foreign_book(f"{tmpdir_fresh}/a.XLSX")
    got = files.read_rosters(spark, f"{tmpdir_fresh}/a.XLSX")
    assert got.columns == ["USN Number", "_c1", "Student Name", "When", "F", "source_file"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == [
        ("0.1", None, None, "1905-01-01 12:00:00", None), ("1000", None, "A\r&_x000D_", "1905-01-01", "TRUE"), ("12", None, None, "06:00:00", None)]
    open(f"{tmpdir_fresh}/b.csv", "w").write("USN Number,When\nU9,NA\n")
    both = files.read_rosters(spark, tmpdir_fresh)
    assert both.count() == 4 and both.where("`USN Number` = 'U9' and When is null").count() == 1
    prof = {os.path.basename(r["source_file"]): (r["n_rows"], len(r["headers"])) for r in files.profile_files(spark, tmpdir_fresh).collect()}
    assert prof == {"a.XLSX": (3, 5), "b.csv": (1, 2)}
    batch = imports.read_batch(spark, tmpdir_fresh)
    clean = {r["row_no"]: r["usn"] for r in upsert.clean_batch(batch, "t").collect()}
    assert clean == {1: "1000", 2: "0.1", 3: "12", 4: "U9"}


@pytest.mark.parametrize("content", [b"", b"not a zip", b"PK\x05\x06" + b"\0" * 18])
def test_what_is_no_workbook_is_an_error(spark, tmpdir_fresh, content):
    open(f"{tmpdir_fresh}/a.xlsx", "wb").write(content)
    if content:
        with pytest.raises(Exception, match="not a readable workbook"):
            files.read_rosters(spark, tmpdir_fresh).collect()
    with pytest.raises(files.ValidationError):
        files.read_rosters(spark, f"{tmpdir_fresh}/a.xls")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]), max_size=12), st.sampled_from(["_x000D_", "_x5F_", "<&>\"'", " a ", "\r\n\t\x00\x1f", "￾"])),
                         min_size=3, max_size=3), max_size=6))
def test_a_written_book_reads_back(rows):
    writer = workbook.BookWriter(["One & <1>", "Two"], ["a", "b", "c"], [[12] * 3] * 2)
    for r in rows:
        writer.row(1, r)
    content = writer.finish() + b"\n"
    book = workbook.Book(content)
    assert [s for s, _ in book.sheets] == ["One & <1>", "Two"] and book.zip.testzip() is None
    assert list(book.rows(0)) == [["a", "b", "c"]]
    kept = [[x or None for x in r] for r in rows]
    got = [r + [None] * (3 - len(r)) for r in book.rows(1)]
    assert got == [["a", "b", "c"], *[r for r in kept if any(r)]]


def test_column_names_of_the_format():
    assert [workbook.column_letters(k) for k in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(workbook.column_number(workbook.column_letters(k) + "12") == k for k in range(800))


def sheets_of(path, names):
    out = {}
    for name in names:
        book = workbook.Book(open(f"{path}/{name}", "rb").read())
        for k, (sheet, _) in enumerate(book.sheets):
            head, *rows = book.rows(k)
            out.setdefault(sheet, []).extend(rows)
    return out


@pytest.mark.parametrize("rows", [40, 1000])
def test_books_hold_the_report_in_order(spark, tmpdir_fresh, rows):
    path = f"{tmpdir_fresh}/out"
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit("é").alias("name"),
                                 F.explode(F.array(F.lit("All"), F.when(F.col("id") % 3 == 0, "Third").otherwise("other"))).alias("sheet"), (-F.col("id")).alias("turn"))
    names = workbook.write_workbooks(df, path, ["All", "Third", "None"], ["k", "name"], [F.col("turn")], rows=rows)
    assert names == [f"allocations-{k:05d}.xlsx" for k in range(-(-100 // rows))] == sorted(os.listdir(path), key=str)[-len(names):]
    assert [x for x in os.listdir(path) if not x.startswith(".")] and not any(x.startswith("_") for x in os.listdir(path))
    got = sheets_of(path, names)
    assert got["All"] == [[str(k), "é"] for k in range(99, -1, -1)]
    assert got["Third"] == [[str(k), "é"] for k in range(99, -1, -3)] and got["None"] == []
    again = workbook.write_workbooks(df, path, ["All", "Third", "None"], ["k", "name"], [F.col("turn")], rows=rows)
    assert sheets_of(path, again) == got  # written over


def test_an_empty_report_has_one_book_and_a_failed_one_none(spark, tmpdir_fresh):
    df = spark.range(0).select(F.lit("x").alias("k"), F.lit("All").alias("sheet"), "id")
    assert sheets_of(f"{tmpdir_fresh}/a", workbook.write_workbooks(df, f"{tmpdir_fresh}/a", ["All"], ["k"], [F.col("id")])) == {"All": []}

    with mock.patch.object(workbook, "_books", lambda *a: (lambda b: (_ for _ in ()).throw(RuntimeError("task lost")))), pytest.raises(Exception, match="task lost"):
        workbook.write_workbooks(spark.range(9).select(F.lit("x").alias("k"), F.lit("All").alias("sheet"), "id"), f"{tmpdir_fresh}/b", ["All"], ["k"], [F.col("id")])
    assert [x for x in os.listdir(f"{tmpdir_fresh}/b")] == []


def test_digests_of_empty_small_and_large_files(spark, tmpdir_fresh, small_ranges):
    rng = random.Random(2)
    contents = {"empty.csv": b"", "small.csv": b"a,b\n", "end.csv": bytes(rng.randrange(256) for _ in range(5000)) + b"\n", "no end.csv": b"\n\n\r\n\xff" * 900 + b"x", "lines.csv": b"\n" * 3000,
                "one%20line.csv": b"z" * 4000}
    for name, data in contents.items():
        open(f"{tmpdir_fresh}/{name}", "wb").write(data)
    got = files.fingerprint(spark, tmpdir_fresh, whole=1000).collect()
    assert sorted((r["length"], r["file_hash"]) for r in got) == sorted((len(d), hashlib.sha256(d).hexdigest()) for d in contents.values())
    one = files.fingerprint(spark, f"{tmpdir_fresh}/empty.csv").collect()
    assert [(r["length"], r["file_hash"]) for r in one] == [(0, hashlib.sha256(b"").hexdigest())]
