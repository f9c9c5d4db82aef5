"""Deterministic stratified cohort split (J4 incremental, J5 fresh).

Rule being reproduced. Eligible members (live, Active, no cohort) are bucketed by
(department or 0, gender) -- or department only without gender balancing. Buckets of a department
are visited in first-seen order (pinned to the bucket's smallest id), members inside a bucket in
SHA-256 order of ``upper(strip(usn))``. Each member then takes the cohort with the fewest members
so far in its department, ties by cohort list order; the counters start from the department's
existing cohort sizes and are shared by all buckets of the department. Existing cohorts never move.

Set-based form (no loop, no per-department group in one task):

* ``n`` = position of a member in its department's visiting order, from the two-phase rank
  (``operators.rank``), so a department holding a third of all members still spreads over all
  range partitions;
* the greedy is a merge of the cohorts' seat ladders: cohort g offers seats at levels e_g, e_g+1,
  ... and seats are taken in (level, cohort index) order. Sort cohorts by (e, idx); between the
  j-th and (j+1)-th smallest seed level exactly the first j cohorts are open, j seats per level.
  That gives per department k "segments" [start, end) of positions, and member n takes
  ``open_cohorts_by_idx[(n - start) mod j]``. The segment table has departments x k rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.operators.rank import ordered_rank
from seatwise.operators.util import live, strip

DEFAULT_COHORTS = ("Group A", "Group B")


def hash_key(usn_col: str = "usn"):
    """C11: deterministic pseudo-random order key, hex SHA-256 of the cleaned usn."""
    return F.sha2(F.upper(strip(F.coalesce(F.col(usn_col), F.lit("")))), 256)


def _eligible_pred():
    return (~F.coalesce(F.col("is_deleted"), F.lit(False)) & (F.col("status") == "Active")
            & F.col("group_name").isNull())


def reset_for_fresh(members: DataFrame) -> DataFrame:
    """J5 first step: clear cohort, bin and slot of every live row (inactive ones included, Q6)."""
    is_live = ~F.coalesce(F.col("is_deleted"), F.lit(False))
    return members.withColumns({
        "group_name": F.when(is_live, F.lit(None).cast("string")).otherwise(F.col("group_name")),
        "bin_id": F.when(is_live, F.lit(None).cast("long")).otherwise(F.col("bin_id")),
        "slot_id": F.when(is_live, F.lit(None).cast("long")).otherwise(F.col("slot_id")),
    })


def hash_order(members: DataFrame, gender_balance: bool = True) -> DataFrame:
    """G1: eligible members with bucket keys, bucket position, hash key and 0-based ``n``.

    ``n`` is the member's position in its department's visiting order.
    """
    e = members.where(_eligible_pred()).withColumns({
        "_dk": F.coalesce(F.col("department_id"), F.lit(0)).cast("long"),
        "_gk": F.col("gender") if gender_balance else F.lit("ALL"),
        "_sha": hash_key(),
    })
    # first-seen order of buckets inside a department, pinned to the smallest id (Q16); a grouped
    # aggregate (partial + final, hot buckets combine map-side) of departments x genders rows,
    # which AQE broadcasts from its measured size, so the member side is not shuffled here
    pos = e.groupBy("_dk", "_gk").agg(F.min("id").alias("_bpos"))
    e = e.join(pos, e["_dk"].eqNullSafe(pos["_dk"]) & e["_gk"].eqNullSafe(pos["_gk"])) \
        .drop(pos["_dk"]).drop(pos["_gk"])
    return ordered_rank(e, [F.col("_bpos"), F.col("_sha"), F.col("id")], {"_n": ["_dk"]})


def seeds(members: DataFrame, cohorts) -> DataFrame:
    """existing cohort sizes per department among live members (any status)."""
    return (live(members).where(F.col("group_name").isin(list(cohorts)))
            .groupBy(F.col("department_id").alias("_dk"), F.col("group_name").alias("_cohort"))
            .agg(F.count(F.lit(1)).alias("_e")))


def segments(depts: DataFrame, seed: DataFrame, cohorts) -> DataFrame:
    """Greedy segments per department: (_dk, _j, _start, _end, _open) with ``_open`` the open
    cohorts in list order. ``_end`` is null for the last, unbounded segment."""
    # one row per (department, cohort): the cohort list is a short parameter, exploded in place
    opts = F.array(*[F.struct(F.lit(i).alias("_idx"), F.lit(c).alias("_cohort")) for i, c in enumerate(cohorts)])
    dc = (depts.select("_dk", F.inline(opts))
          .join(seed, ["_dk", "_cohort"], "left")
          .withColumn("_e", F.coalesce(F.col("_e"), F.lit(0)).cast("long")))
    w = Window.partitionBy("_dk").orderBy("_e", "_idx")
    dc = dc.withColumn("_j", F.row_number().over(w))
    wj = Window.partitionBy("_dk").orderBy("_j")
    seg = (dc.withColumn("_enext", F.lead("_e").over(wj))
           .withColumn("_len", F.col("_j") * (F.col("_enext") - F.col("_e")))
           .withColumn("_start", F.coalesce(F.sum("_len").over(wj.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0)).cast("long"))
           .withColumn("_open", F.collect_list(F.struct("_idx", "_cohort"))
                       .over(wj.rowsBetween(Window.unboundedPreceding, 0))))
    return seg.select(
        "_dk", "_j", "_start",
        F.when(F.col("_enext").isNull(), F.lit(None)).otherwise(F.col("_start") + F.col("_len"))
         .cast("long").alias("_end"),
        F.transform(F.array_sort("_open"), lambda s: s["_cohort"]).alias("_open"))


def split_cohorts(members: DataFrame, cohorts=DEFAULT_COHORTS, gender_balance: bool = True,
                  fresh: bool = False) -> DataFrame:
    """J4 (``fresh=False``) / J5 (``fresh=True``): the member table with new cohorts filled in.

    Rows that were not eligible pass through untouched (no join with the member table).
    ``group_allocated`` marks the rows assigned by this run.
    """
    cohorts = list(cohorts)
    if len(cohorts) < 2:
        raise ValueError("At least 2 target cohorts are required for allocation.")
    base = reset_for_fresh(members) if fresh else members
    ranked = hash_order(base, gender_balance)
    seg = segments(ranked.select("_dk").distinct(), seeds(base, cohorts), cohorts)
    # departments x cohorts rows: AQE broadcasts it from its measured size
    cond = ((ranked["_dk"] == seg["_dk"]) & (ranked["_n"] >= seg["_start"])
            & (seg["_end"].isNull() | (ranked["_n"] < seg["_end"])))
    assigned = ranked.join(seg, cond).withColumn(
        "group_name", F.element_at(F.col("_open"), ((F.col("_n") - F.col("_start")) % F.col("_j") + 1).cast("int")))
    cols = members.columns
    new = assigned.select(*cols).withColumn("group_allocated", F.lit(True))
    # the predicate is null for a null status: such rows are not eligible and pass through
    rest = base.where(~F.coalesce(_eligible_pred(), F.lit(False))).select(*cols) \
        .withColumn("group_allocated", F.lit(False))
    return new.unionByName(rest)


def split_result(before: DataFrame, after: DataFrame) -> DataFrame:
    """processed, newly assigned, skipped = rows (deleted ones too) with a cohort - newly."""
    newly = after.agg(F.count_if(F.col("group_allocated")).alias("newly_allocated"))
    with_cohort = after.agg(F.count_if(F.col("group_name").isNotNull())).scalar()
    return newly.select(F.col("newly_allocated").alias("total_processed"), "newly_allocated",
                        (with_cohort - F.col("newly_allocated")).alias("skipped_existing"))


def cohort_sizes(after: DataFrame) -> DataFrame:
    """cohort sizes among live members after a run."""
    return (live(after).where(F.col("group_name").isNotNull())
            .groupBy("group_name").agg(F.count(F.lit(1)).alias("n")))
