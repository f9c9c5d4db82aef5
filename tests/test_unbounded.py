"""Reports, event facts and file hashes beyond the sizes that one row or the driver's lists hold."""

import datetime as dt
import hashlib
import pathlib

import duckdb

import __spark_entry__ as E
from seatwise.operators import imports, report, seating
from seatwise.sources import files
from seatwise.sources import testdata as td
from tests.conftest import SF001

MAX_LENGTH = "spark.sql.sources.binaryFile.maxLength"


def test_event_long_matches_its_sql_and_the_pivot(spark):
    con = duckdb.connect()
    for t in td.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got = E.queries()["export_event_long"](spark, SF001)
    rows = [tuple(r) for r in got.collect()]
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({E.oracle_sql()['export_event_long']}) x").fetchall()
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    wide = E.queries()["export_event_pivot"](spark, SF001).collect()
    events = report.event_names(td.facts(spark, SF001))
    cells = [(r["sheet"], r["id"], e, r[e]) for r in wide for e in events]
    assert sorted(cells) == sorted(tuple(r) for r in got.select("sheet", "id", "event_name", "venue").collect())


def test_event_long_of_more_events_than_columns(spark):
    m, n = td.member(spark, SF001).where("id <= 12"), report.MAX_PIVOT_EVENTS + 5
    facts = spark.range(n).selectExpr("id", "1L as member_id", "concat('e', id) as event_name", "concat('=', id) as bin_name")
    out = report.event_long(m, facts, td.dept(spark, SF001), td.bins(spark, SF001)).where("sheet = 'Master Allocation'")
    assert out.count() == n * m.where("not is_deleted").count()
    assert {r["venue"] for r in out.where("id = 1").collect()} == {f"'={k}" for k in range(n)}
    none = report.event_long(m, facts.limit(0), td.dept(spark, SF001), td.bins(spark, SF001))
    assert {r["event_name"] for r in none.collect()} == {"Venue"}


def test_event_facts_from_a_table_of_any_size(spark):
    seats = spark.createDataFrame([(1, "Hall", "Group A"), (2, None, "Group A")], "id long, bin_name string, group_name string")
    events = spark.range(20_000).selectExpr("concat(' e', id, ' ') as event_name")
    out = seating.event_facts(seats, events)
    assert out.columns == ["member_id", "event_name", "bin_name", "group_name"]
    assert out.count() == out.select("member_id", "event_name").distinct().count() == 40_000
    assert out.where("event_name like ' %' or event_name like '% '").count() == 0
    assert {r["event_name"] for r in seating.event_facts(seats, events.limit(0)).collect()} == {"Event 1"}


def test_hash_of_a_file_too_large_for_a_row(spark, tmpdir_fresh):
    texts = {"a.csv": "Student Name,USN\nAda,U1\n", "b c%41#.csv": "Student Name,USN\n" + "".join(f"Name {k},V{k}\n" for k in range(500))}
    for name, text in texts.items():
        (pathlib.Path(tmpdir_fresh) / name).write_text(text)
    want = sorted(hashlib.sha256(x.encode()).hexdigest() for x in texts.values())
    kept = spark.conf.get(MAX_LENGTH)
    spark.conf.set(MAX_LENGTH, "1000")
    try:
        got = files.fingerprint(spark, tmpdir_fresh).collect()
        assert sorted(r["file_hash"] for r in got) == want and {r["length"] for r in got} == {len(x) for x in texts.values()}
        ledger = "id long, file_name string, file_hash string, total_rows long, new_records long, updated_records long, duplicate_records long, imported_at timestamp_ntz"
        out = imports.import_files(spark, tmpdir_fresh, td.member(spark, SF001), td.dept(spark, SF001), td.program(spark, SF001),
                                   spark.createDataFrame([], ledger), 9, dt.datetime(2024, 6, 1), "t")["ledger"].collect()
        two = sorted(hashlib.sha256(texts[x].encode()).hexdigest() for x in texts)
        assert [(r["total_rows"], r["file_hash"]) for r in out] == [(501, hashlib.sha256("\n".join(two).encode()).hexdigest())]
    finally:
        spark.conf.set(MAX_LENGTH, kept)
