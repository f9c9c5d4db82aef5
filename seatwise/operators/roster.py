"""Roster queries (J12): denormalised view, search, filters, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.operators.rank import ordered_rank
from seatwise.operators.util import all_of, blank_to_null, live

UNASSIGNED = "Unassigned"


def denormalise(members: DataFrame, dept: DataFrame, program: DataFrame, bins: DataFrame,
                slots: DataFrame, live_only: bool = True) -> DataFrame:
    """Members left-joined to their four dimensions, with the roster's null labels.

    The dimensions are small; Spark broadcasts them by size (autoBroadcastJoinThreshold / AQE),
    so the member side is never shuffled.
    """
    m = live(members) if live_only else members
    d = dept.select(F.col("id").alias("_d_id"), F.col("name").alias("_d_name"))
    p = program.select(F.col("id").alias("_p_id"), F.col("name").alias("_p_name"))
    b = bins.select(F.col("id").alias("_b_id"), F.col("name").alias("_b_name"))
    s = slots.select(F.col("id").alias("_s_id"), F.col("slot_name").alias("_s_name"))
    j = (m.join(d, m["department_id"] == d["_d_id"], "left")
         .join(p, m["program_id"] == p["_p_id"], "left")
         .join(b, m["bin_id"] == b["_b_id"], "left")
         .join(s, m["slot_id"] == s["_s_id"], "left"))
    return j.select(
        "id", "usn", "student_id", "student_number", "full_name", "gender",
        F.when(F.col("_d_id").isNull(), UNASSIGNED).otherwise(F.col("_d_name")).alias("department"),
        F.coalesce(F.col("_p_name"), F.lit("")).alias("program"),
        F.coalesce(blank_to_null(F.col("group_name")), F.lit(UNASSIGNED)).alias("group_name"),
        F.when(F.col("_b_id").isNull(), UNASSIGNED).otherwise(F.col("_b_name")).alias("venue"),
        F.when(F.col("_s_id").isNull(), UNASSIGNED).otherwise(F.col("_s_name")).alias("time_slot"),
        "status", "department_id", "program_id", "bin_id", "slot_id",
    )


def search(members: DataFrame, term: str | None) -> DataFrame:
    """Case-insensitive contains-search over usn, student_id, student_number, full_name.

    ``%`` and ``_`` typed by the user act as wildcards, as in the stored-query original; a backslash
    is an ordinary character.
    Blank term = no filter.
    """
    if term is None or not term.strip():
        return members
    pat = "%" + term.strip().replace("\\", "\\\\") + "%"
    cols = ["usn", "student_id", "student_number", "full_name"]
    pred = None
    for c in cols:
        p = F.coalesce(F.col(c).ilike(pat), F.lit(False))
        pred = p if pred is None else (pred | p)
    return members.filter(pred)


def filtered(members: DataFrame, department_id=None, program_id=None, group_name=None,
             bin_id=None, slot_id=None, gender=None, status=None) -> DataFrame:
    """Optional equality filters; falsy values (and "All" for gender/status) are skipped."""
    preds = []
    for col, val in (("department_id", department_id), ("program_id", program_id),
                     ("group_name", group_name), ("bin_id", bin_id), ("slot_id", slot_id)):
        if val:
            preds.append(F.col(col) == F.lit(val))
    for col, val in (("gender", gender), ("status", status)):
        if val and val != "All":
            preds.append(F.col(col) == F.lit(val))
    return members.filter(all_of(preds))


def unassigned(members: DataFrame) -> DataFrame:
    """D7, fixed: the "Unassigned" filter choice selects members without a cohort."""
    return members.filter(blank_to_null(F.col("group_name")).isNull())


def page(members: DataFrame, limit: int | None = 50, offset: int | None = 0,
         order_col: str = "usn") -> tuple[DataFrame, DataFrame]:
    """H1: (rows ordered by usn after offset/limit, one-row total before paging).

    Spark plans the page as TakeOrderedAndProject (per-partition top offset+limit, then merge);
    the total is a separate global count with map-side partial aggregation.
    """
    total = members.agg(F.count(F.lit(1)).alias("total"))
    ordered = members.orderBy(F.col(order_col).asc_nulls_first(), F.col("id"))
    if offset:
        ordered = ordered.offset(offset)
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered, total


PAGE_BLOCK = 100_000  # rows of one block of a page index


def write_page_index(members: DataFrame, path: str, order_col: str = "usn", block: int = PAGE_BLOCK) -> None:
    """H1 for deep pages: the rows with their rank in page order, as a table of blocks of consecutive ranks.

    Ranks come from range partitions and their counts, so no task holds more than a range. The index is
    that of the rows when it was written; write it again after they change.
    """
    ranked = ordered_rank(members, [F.col(order_col), F.col("id")], {"_rank": []})  # nulls first
    cut = ranked.withColumn("_block", F.floor(F.col("_rank") / block))
    cut.repartition("_block").sortWithinPartitions("_rank").write.mode("overwrite").partitionBy("_block").parquet(path)


def read_page(spark: SparkSession, path: str, limit: int, offset: int, block: int = PAGE_BLOCK) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a page index: only the blocks that hold them are read, however deep the page."""
    at = (F.col("_rank") >= offset) & (F.col("_rank") < offset + limit)
    rows = spark.read.parquet(path).where(F.col("_block").between(offset // block, (offset + max(1, limit) - 1) // block) & at)
    return rows.orderBy("_rank").drop("_rank", "_block")
