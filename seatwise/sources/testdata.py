"""The member/bin/slot/... views derived from the generated test tables.

The same views are written in SQL
in ``seatwise.plans.fixtures`` for the DuckDB oracle. Only DataFrame API here.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatwise.operators.rank import ordered_rank
from seatwise.operators.util import ntz_lit

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

EPOCH = _dt.datetime(2024, 1, 1)
MEMBER_CREATED_STEP_S = 1723  # seconds between consecutive members' created_at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departments = distinct market segments, ids in name order (a handful of rows)."""
    segs = (table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
            .where(F.col("name").isNotNull()).distinct())
    # window over the distinct names only: bounded by the number of segments
    return segs.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name",
                       F.upper(F.substring("name", 1, 4)).alias("code"))


def member(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    d = dept(spark, sf_dir).select(F.col("id").alias("department_id"), F.col("name").alias("_dn"))
    k = F.col("c_custkey")
    m = c.join(d, c["c_mktsegment"] == d["_dn"], "left")
    return m.select(
        (k + 1).cast("long").alias("id"),
        F.col("c_name").alias("usn"),
        F.concat(F.lit("ID"), (k + 1).cast("string")).alias("student_id"),
        F.lit(None).cast("string").alias("student_number"),
        F.concat(F.lit("Member "), k.cast("string")).alias("full_name"),
        F.when(F.col("c_nationkey") % 3 == 0, "Male").when(F.col("c_nationkey") % 3 == 1, "Female")
         .otherwise("Unknown").alias("gender"),
        F.when(F.col("c_acctbal") < -800, "Inactive").otherwise("Active").alias("status"),
        F.col("department_id").cast("long").alias("department_id"),
        F.col("c_nationkey").cast("long").alias("program_id"),
        F.when(k % 4 == 1, k % 97).cast("long").alias("import_id"),
        F.when(k % 10 == 0, F.lit("Group A")).alias("group_name"),
        F.when(k % 7 == 3, k % 10 + 1).cast("long").alias("bin_id"),
        F.when(k % 7 == 3, k % 5 + 1).cast("long").alias("slot_id"),
        (ntz_lit(EPOCH)
         + F.make_dt_interval(secs=(k * MEMBER_CREATED_STEP_S).cast("decimal(18,6)"))).alias("created_at"),
        ((k % 50) == 7).alias("is_deleted"),
    )


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select((k + 1).cast("long").alias("id"), F.col("s_name").alias("name"),
                    (3 + k % 5).cast("long").alias("capacity"),
                    F.lit(None).cast("string").alias("location"),
                    (k % 10 != 9).alias("is_active"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("slot_name"),
                    F.lit("09:00 AM").alias("start_time"), F.lit("11:00 AM").alias("end_time"),
                    F.lit(1).alias("day_number"))


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
                    F.col("n_name").alias("code"))


def event_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("event_name")).agg(F.min("event_id").alias("first_id"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior event-assignment facts (member x event -> bin name), one per event row."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") + 1).cast("long").alias("member_id"),
                    F.col("event_type").alias("event_name"),
                    F.concat(F.lit("Hall "), (F.col("event_id") % 7).cast("string")).alias("bin_name"),
                    F.lit("Group A").alias("group_name"), F.col("ts").alias("created_at"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert input: one row per order, row_no in (o_orderdate, o_orderkey) order; every third order
    key has a usn that no member has."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                              "o_orderpriority", "o_orderstatus")
    ranked = ordered_rank(o, [F.col("o_orderdate"), F.col("o_orderkey")])
    return ranked.select(
        (F.col("rank0") + 1).cast("long").alias("row_no"),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, "New#").otherwise("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("usn"),
        F.col("o_orderpriority").alias("department"),
        F.col("o_orderstatus").alias("program"))


#: Headers that hit a field exactly (by any spelling), nearly, at exactly 80, or not; None: the part's name.
HEADER_NAMES = ["USN_Number", " Dept ", "Sex", "Degree", "Studnt Name", "SI.No.", "Regn No", None, "Remarks", "Name", "Candidate-Name", "sl no", "  ", "Roll Nmber",
                "Enrolment ID", "Gender (M/F)", "stream course", None, "Mobile", "branch", "Id", "Program/Name", "number student"]


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw batch as uploads have it, a row per customer: blank, missing and padded cells, ids in one column only, gender words."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")

    def cycle(n, *values):
        out = F.lit(None).cast("string")
        for i, v in enumerate(values):
            out = F.when(k % n == i, v).otherwise(out)
        return out

    return c.select(
        (k + 1).cast("long").alias("row_no"),
        cycle(7, F.lit(""), F.concat(F.lit(" "), F.col("c_name"), F.lit("\t")), F.lit("NaN"), F.col("c_name"), F.lit("null"), F.lower(F.col("c_name"))).alias("usn"),
        cycle(5, F.concat(F.lit("ID"), k.cast("string")), F.lit(" "), F.lit(None).cast("string"), F.concat(F.lit(" x"), k.cast("string"))).alias("student_id"),
        cycle(4, F.concat(F.lit("  Member "), k.cast("string")), F.lit("None"), F.lit("")).alias("full_name"),
        cycle(6, F.col("c_mktsegment"), F.lit(" nan "), F.concat(F.col("c_mktsegment"), F.lit(" "))).alias("department"),
        cycle(3, F.lit(" MBA "), F.lit("")).alias("program"),
        cycle(9, F.lit(" M"), F.lit("female "), F.lit("Boy"), F.lit("F"), F.lit("WOMAN"), F.lit("o"), F.lit("Other"), F.col("c_mktsegment")).alias("gender"),
        cycle(8, k.cast("string"), F.lit(" 7 ")).alias("student_number"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"),
                    F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"),
                             F.lit(".csv")).alias("file_name"),
                    F.sha2(F.col("props"), 256).alias("file_hash"),
                    F.floor(F.col("value")).cast("long").alias("total_rows"),
                    F.lit(0).cast("long").alias("new_records"),
                    F.lit(0).cast("long").alias("updated_records"),
                    F.lit(0).cast("long").alias("duplicate_records"),
                    F.col("ts").alias("imported_at"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.upper(F.col("event_type")).alias("action"),
                    F.lit("Event").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"),
                    F.col("props").alias("details"), F.col("ts").alias("created_at"))


def dim_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text dimension names (part names) for code derivation and resolve."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("row_no"), F.col("p_name").alias("name"))
