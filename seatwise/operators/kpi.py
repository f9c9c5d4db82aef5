"""Dashboard and planner aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.operators.util import blank_to_null, live


def cards(members: DataFrame) -> DataFrame:
    """one pass, four counts over live members (not restricted to Active)."""
    m = live(members)
    return m.agg(
        F.count(F.lit(1)).alias("total_members"),
        F.count_if(F.col("group_name").isNotNull()).alias("allocated_groups"),
        F.count_if(F.col("bin_id").isNotNull()).alias("allocated_bins"),
        F.count_if(F.col("group_name").isNull()).alias("pending_allocation"),
    )


def by_label(members: DataFrame, col: str, missing: str, out: str) -> DataFrame:
    """count by a column; null or '' fall under the ``missing`` label."""
    m = live(members)
    return (m.groupBy(F.coalesce(blank_to_null(F.col(col)), F.lit(missing)).alias(out))
            .agg(F.count(F.lit(1)).alias("n")))


def by_cohort(members: DataFrame) -> DataFrame:
    return by_label(members, "group_name", "Unassigned", "group_name")


def by_gender(members: DataFrame) -> DataFrame:
    return by_label(members, "gender", "Unknown", "gender")


def by_department(members: DataFrame, dept: DataFrame) -> DataFrame:
    """Inner join to departments (members without one drop out), count per name."""
    m = live(members).groupBy("department_id").agg(F.count(F.lit(1)).alias("n"))
    # aggregate first: the join then sees one row per department, not one per member
    d = dept.select(F.col("id").alias("department_id"), F.col("name").alias("department"))
    return m.join(d, "department_id").groupBy("department").agg(F.sum("n").cast("long").alias("n"))


def share(counts: DataFrame, n_col: str = "n", total: DataFrame | None = None) -> DataFrame:
    """Whole percent of total, half up; a zero total counts as 1.

    ``total`` is a one-row frame with column ``total``; default: the sum of ``n_col``.
    """
    if total is None:
        total = counts.agg(F.sum(n_col).alias("total"))
    t = total.select(F.greatest(F.col("total"), F.lit(1))).scalar()  # scalar subquery, runs once
    return counts.withColumn("pct", F.floor((F.col(n_col) / t) * 100 + 0.5).cast("long"))


def occupancy(members: DataFrame, bins: DataFrame, per_slot: bool = False) -> DataFrame:
    """Filled seats per active bin, remaining and fill percent.

    Default keeps the original rule (quirk Q5): ``filled`` counts all slots while ``capacity`` is
    one slot's. ``per_slot=True`` gives one row per (bin, slot) instead.
    """
    keys = ["bin_id", "slot_id"] if per_slot else ["bin_id"]
    filled = (live(members).where(F.col("bin_id").isNotNull())
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("filled")))
    b = bins.where(F.col("is_active")).select(F.col("id").alias("bin_id"), "name", "capacity")
    out = b.join(filled, "bin_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)).cast("long"))
    return out.select(
        *keys, "name", "capacity", "filled",
        F.greatest(F.col("capacity") - F.col("filled"), F.lit(0)).alias("remaining"),
        F.least(F.lit(100), F.floor((F.col("filled") / F.greatest(F.col("capacity"), F.lit(1))) * 100 + 0.5))
         .cast("long").alias("fill_pct"),
    )


def dept_cohort(members: DataFrame, dept: DataFrame, cohorts=("Group A", "Group B")) -> DataFrame:
    """per department (all of them, zero included): total and one count per cohort."""
    aggs = [F.count(F.lit(1)).alias("total")] + [
        F.count_if(F.col("group_name") == c).alias(_cohort_col(c)) for c in cohorts]
    per = live(members).groupBy("department_id").agg(*aggs)
    d = dept.select(F.col("id").alias("department_id"), F.col("name").alias("department"))
    out = d.join(per, "department_id", "left")
    return out.select("department_id", "department",
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                        for c in ["total"] + [_cohort_col(c) for c in cohorts]])


def _cohort_col(c: str) -> str:
    return "n_" + c.lower().replace(" ", "_")


def eligible_for_seating(members: DataFrame, target_group: str | None = None) -> DataFrame:
    """D3: live, Active, not yet seated, optionally one cohort."""
    m = live(members).where((F.col("status") == "Active") & F.col("bin_id").isNull())
    if target_group:
        m = m.where(F.col("group_name") == target_group)
    return m


@dataclass
class CapacityReport:
    total_members: int
    total_capacity: int
    is_sufficient: bool
    deficiency: int
    n_slots: int

    @property
    def extra_per_slot(self) -> int:
        if self.deficiency > 0 and self.n_slots > 0:
            return -(-self.deficiency // self.n_slots)
        return 0


def capacity_frame(members: DataFrame, bins: DataFrame, slots: DataFrame,
                   target_group: str | None = None) -> DataFrame:
    """F7 as a one-row DataFrame: demand, seats over all slots, sufficient, deficiency, extra per slot."""
    demand = eligible_for_seating(members, target_group).agg(F.count(F.lit(1)).alias("total_members"))
    seats = bins.where(F.col("is_active")).agg(F.coalesce(F.sum("capacity"), F.lit(0)).cast("long")).scalar()
    ns = slots.agg(F.count(F.lit(1))).scalar()
    r = demand.withColumns({"per_slot": seats, "n_slots": ns})
    cap = (F.col("per_slot") * F.col("n_slots")).cast("long")
    dfc = F.greatest(F.col("total_members") - cap, F.lit(0)).cast("long")
    return r.select(
        "total_members", cap.alias("total_capacity"), (cap >= F.col("total_members")).alias("is_sufficient"),
        dfc.alias("deficiency"),
        F.when((dfc > 0) & (F.col("n_slots") > 0),
               F.floor((dfc + F.col("n_slots") - 1) / F.col("n_slots"))).otherwise(0).cast("long")
         .alias("extra_per_slot"),
        "n_slots")


def capacity_report(members: DataFrame, bins: DataFrame, slots: DataFrame,
                    target_group: str | None = None) -> CapacityReport:
    """F7 on the driver (a one-row result) for the capacity guard J8."""
    r = capacity_frame(members, bins, slots, target_group).first()
    return CapacityReport(int(r["total_members"]), int(r["total_capacity"]), bool(r["is_sufficient"]),
                          int(r["deficiency"]), int(r["n_slots"]))


def capacity_suggestion(members: DataFrame, bins: DataFrame, slots: DataFrame,
                        target_group: str | None = None) -> DataFrame:
    """F7 suggestion, fixed Q17: one row per slot id with the extra seats it needs (none if enough)."""
    extra = capacity_frame(members, bins, slots, target_group).select("extra_per_slot").scalar()
    return (slots.withColumn("extra_per_slot", extra)
            .where(F.col("extra_per_slot") > 0)
            .select(F.col("id").alias("slot_id"), "slot_name", "day_number", "extra_per_slot"))


def capacity_totals(members: DataFrame, bins: DataFrame, slots: DataFrame) -> DataFrame:
    """F8: all live members and seats over max(slots, 1)."""
    n = live(members).agg(F.count(F.lit(1)).alias("total_members"))
    seats = bins.where(F.col("is_active")).agg(F.coalesce(F.sum("capacity"), F.lit(0))).scalar()
    ns = slots.agg(F.count(F.lit(1))).scalar()
    return n.select("total_members",
                    (seats * F.greatest(ns, F.lit(1))).cast("long").alias("total_capacity"))


def recent(df: DataFrame, ts_col: str, k: int, cols: list) -> DataFrame:
    """H2/H3: k most recent rows, newest first, id as tiebreak (TakeOrderedAndProject)."""
    return df.orderBy(F.col(ts_col).desc_nulls_last(), F.col("id").desc()).limit(k).select(*cols)


def fmt_ts(c: str, with_seconds: bool = True):
    """Timestamp text."""
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss" if with_seconds else "HH:mm")
