"""Reports and sinks: event pivot (B3), flat roster (B1), cohort roster (B2), attendance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.operators.rank import ordered_rank
from seatwise.operators.util import blank_to_null, live, strip

MAX_PIVOT_EVENTS = 1000  # pivot columns are event names: a short configured list by nature


def sanitise(c):
    """Trim; prefix ``'`` when the text starts with = + - @ (formula-injection guard)."""
    t = strip(c)
    return F.when(t.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)


def first_seen_events(facts: DataFrame) -> DataFrame:
    """distinct event names in first-seen order (smallest fact id)."""
    ev = facts.groupBy("event_name").agg(F.min("id").alias("first_id"))
    return ev.withColumn("ord", (F.row_number().over(Window.orderBy("first_id")) - 1).cast("long"))


def event_names(facts: DataFrame) -> list[str]:
    """The pivot's column list (bounded: raises beyond ``MAX_PIVOT_EVENTS`` distinct events)."""
    rows = first_seen_events(facts).orderBy("ord").limit(MAX_PIVOT_EVENTS + 1).collect()
    if len(rows) > MAX_PIVOT_EVENTS:
        raise ValueError(f"more than {MAX_PIVOT_EVENTS} distinct events: not a pivot report")
    return [r["event_name"] for r in rows] or ["Venue"]


def _sheets(members: DataFrame, dept: DataFrame, bins: DataFrame, cohort: str | None):
    """Live members of the report with department and own bin, its member columns, its sheets."""
    m = live(members)
    if cohort and cohort.strip() and cohort.strip().lower() not in ("master", "all"):
        c = cohort.strip()
        m = m.where(F.col("group_name") == c)
        sheets = [(f"{c} Allocations"[:31], None)]
    else:
        sheets = [("Master Allocation", None), ("Group A", "Group A"), ("Group B", "Group B")]
    d = dept.select(F.col("id").alias("_did"), F.col("name").alias("_dname"))
    b = bins.select(F.col("id").alias("_bid"), F.col("name").alias("_bname"))
    j = m.join(d, m["department_id"] == d["_did"], "left").join(b, m["bin_id"] == b["_bid"], "left")
    about = [
        "id", F.col("group_name").alias("_g"),
        sanitise(F.col("usn")).alias("usn"), sanitise(F.col("full_name")).alias("full_name"),
        sanitise(F.col("gender")).alias("gender"),
        sanitise(F.coalesce(F.col("_dname"), F.lit(""))).alias("department"),
        sanitise(F.coalesce(F.col("group_name"), F.lit(""))).alias("group_name")]
    return j, about, sheets


def _on_sheets(rows: DataFrame, sheets) -> DataFrame:
    # every row lands on the master sheet and on its own cohort's sheet: one pass, exploded
    opts = [F.when(F.lit(True) if only is None else (F.col("_g") == only), F.lit(title)) for title, only in sheets]
    return (rows.withColumn("sheet", F.explode(F.filter(F.array(*opts), lambda x: x.isNotNull())))
            .drop("_g"))


def event_pivot(members: DataFrame, facts: DataFrame, dept: DataFrame, bins: DataFrame,
                cohort: str | None = None, events: list[str] | None = None) -> DataFrame:
    """One row per live member, one column per event.

    Cell = venue of the member's last fact (by id) for that event, else the member's own bin,
    else "". Everything sanitised. Without a cohort the master sheet is followed by one sheet per
    default cohort (column ``sheet``); with a cohort, only its sheet. Report order (H5) is
    (cohort, usn) with nulls first -- apply ``orderBy(sheet, group_name, usn)`` when writing.
    ``event_long`` has the same cells for any number of events.
    """
    j, about, sheets = _sheets(members, dept, bins, cohort)
    events = events or event_names(facts)
    last = (facts.groupBy("member_id").pivot("event_name", events)
            .agg(F.max_by("bin_name", "id")))
    j = j.join(last, j["id"] == last["member_id"], "left")
    cells = [sanitise(F.coalesce(blank_to_null(F.col(f"`{e}`")) if e in last.columns else F.lit(None),
                                 F.col("_bname"), F.lit(""))).alias(e) for e in events]
    return _on_sheets(j.select(*about, *cells), sheets)


def event_long(members: DataFrame, facts: DataFrame, dept: DataFrame, bins: DataFrame,
               cohort: str | None = None) -> DataFrame:
    """The cells of ``event_pivot`` as rows: one per sheet, live member and event, with its venue.

    Events are joined as a table, so their number isn't bounded; without facts the event is "Venue".
    """
    j, about, sheets = _sheets(members, dept, bins, cohort)
    events = facts.select("event_name").distinct()
    if events.isEmpty():
        events = facts.sparkSession.range(1).select(F.lit("Venue").alias("event_name"))
    last = (facts.groupBy(F.col("member_id").alias("_m"), F.col("event_name").alias("_e"))
            .agg(F.max_by("bin_name", "id").alias("_venue")))
    j = j.crossJoin(events).join(last, (F.col("id") == F.col("_m")) & F.col("event_name").eqNullSafe(F.col("_e")), "left")
    venue = sanitise(F.coalesce(blank_to_null(F.col("_venue")), F.col("_bname"), F.lit(""))).alias("venue")
    return _on_sheets(j.select(*about, "event_name", venue), sheets)


def flat_roster(members: DataFrame, dept: DataFrame, program: DataFrame, bins: DataFrame,
                slots: DataFrame) -> DataFrame:
    """B1: the ten-column roster, sanitised, with its null labels; write ordered by usn."""
    m = live(members)
    d = dept.select(F.col("id").alias("_did"), F.col("name").alias("_dname"))
    p = program.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    b = bins.select(F.col("id").alias("_bid"), F.col("name").alias("_bname"))
    s = slots.select(F.col("id").alias("_sid"), F.col("slot_name").alias("_sname"))
    j = (m.join(d, m["department_id"] == d["_did"], "left").join(p, m["program_id"] == p["_pid"], "left")
         .join(b, m["bin_id"] == b["_bid"], "left").join(s, m["slot_id"] == s["_sid"], "left"))
    return j.select(
        F.col("id"),
        sanitise(F.col("usn")).alias("USN"),
        sanitise(F.coalesce(blank_to_null(F.col("student_id")), F.lit(""))).alias("Student ID"),
        sanitise(F.col("full_name")).alias("Full Name"),
        sanitise(F.col("gender")).alias("Gender"),
        sanitise(F.coalesce(F.col("_dname"), F.lit(""))).alias("Department"),
        sanitise(F.coalesce(F.col("_pname"), F.lit(""))).alias("Program"),
        sanitise(F.coalesce(blank_to_null(F.col("group_name")), F.lit("Unassigned"))).alias("Group"),
        sanitise(F.when(F.col("_bid").isNull(), "Unassigned").otherwise(F.col("_bname"))).alias("Venue"),
        sanitise(F.when(F.col("_sid").isNull(), "Unassigned").otherwise(F.col("_sname"))).alias("Time Slot"),
        sanitise(F.col("status")).alias("Status"))


def write_csv(df: DataFrame, path: str, order: list | None = None, partition_by: list | None = None) -> None:
    """CSV sink with a header. A global ``orderBy`` range-partitions the output, so the part
    files read in name order give the report order without funnelling through one task."""
    out = df.orderBy(*order) if order else df
    # quotes are doubled, as the readers of this package and spreadsheets expect
    w = out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def cohort_roster(roster: DataFrame, cohort: str | None) -> DataFrame:
    """B2, fixed (Q2): the per-cohort export holds only that cohort's rows."""
    if not cohort:
        return roster
    return roster.where(F.col("Group") == cohort)


def attendance(members: DataFrame, dept: DataFrame, bins: DataFrame, slots: DataFrame,
               bin_id: int | None = None) -> DataFrame:
    """Attendance table in (cohort, department id, name) order with a serial number.

    The serial is a global row number computed by the two-phase rank (no single-task window).
    """
    m = live(members)
    if bin_id:
        m = m.where(F.col("bin_id") == bin_id)
    d = dept.select(F.col("id").alias("_did"), F.col("name").alias("_dname"))
    b = bins.select(F.col("id").alias("_bid"), F.col("name").alias("_bname"))
    s = slots.select(F.col("id").alias("_sid"), F.col("slot_name").alias("_sname"))
    j = (m.join(d, m["department_id"] == d["_did"], "left").join(b, m["bin_id"] == b["_bid"], "left")
         .join(s, m["slot_id"] == s["_sid"], "left"))
    j = j.select("id", "usn", "full_name", "group_name", "department_id", "_dname", "_bname", "_sname")
    r = ordered_rank(j, [F.col("group_name"), F.col("department_id"), F.col("full_name"), F.col("id")])
    return r.select(
        (F.col("rank0") + 1).alias("serial"), "id", "usn", "full_name",
        F.coalesce(F.substring(F.col("_dname"), 1, 15), F.lit("")).alias("dept"),
        F.coalesce(F.col("group_name"), F.lit("")).alias("group_name"),
        F.concat(F.coalesce(F.col("_bname"), F.lit("N/A")), F.lit("\n("),
                 F.coalesce(F.col("_sname"), F.lit("N/A")), F.lit(")")).alias("venue_slot"),
        F.lit("[  ] Present").alias("signature"))
