"""Proportional slot seating (J6) and cohort seating for events.

J6 pipeline, all set-based:

1. capacity guard (F7/J8) on a one-row aggregate; raises before anything is written;
2. global position of every eligible member in (usn, name, id) order and its position inside its
   stratum (department or 0, gender or "Unknown") -- one two-phase rank pass (``operators.rank``);
3. slot = even split of positions over slots in id order (G3, the ``ntile`` formula);
4. strata sizes per slot (F13) and bin targets per slot size (G4), both dimension-sized;
5. strata matrix per slot (G5/G6), folded in Python over cells only;
6. members find their bin through an equi-join on (slot, stratum, bucket) with the quota ranges
   (E6), where buckets turn ``lo <= seq < hi`` into an equality without scanning all bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.operators import apportion, kpi
from seatwise.operators.rank import ordered_rank
from seatwise.operators.util import BROADCAST_ROW_LIMIT, blank_to_null, local_frame, ntz_lit, strip


class CapacityExceededError(Exception):
    """Not enough seats over all slots for the members waiting to be seated."""

    def __init__(self, required: int, available: int):
        super().__init__(
            f"Insufficient total capacity: {required} members need seats, {available} available; "
            f"shortfall {max(0, required - available)} seats.")
        self.required_capacity = required
        self.available_capacity = available


def stratum_cols(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "dk": F.coalesce(F.col("department_id"), F.lit(0)).cast("long"),
        "gk": F.coalesce(blank_to_null(F.col("gender")), F.lit("Unknown")),
    })


def seat_order():
    """(usn, name, id) with missing text as ''."""
    return [F.coalesce(F.col("usn"), F.lit("")), F.coalesce(F.col("full_name"), F.lit("")), F.col("id")]


def slot_of(rank0, n: int, s: int):
    """G3 as a formula: ``ntile(s)`` over ``n`` ordered rows, 0-based slot index of ``rank0``."""
    q, r = divmod(n, s)
    big = r * (q + 1)
    if q == 0:
        return F.floor(rank0 / F.lit(q + 1)).cast("long")
    return F.when(rank0 < big, F.floor(rank0 / F.lit(q + 1))) \
        .otherwise(F.lit(r) + F.floor((rank0 - big) / F.lit(q))).cast("long")


def slot_index(slots: DataFrame) -> DataFrame:
    """Slots in id order with a 0-based index (a window over the slot dimension only)."""
    return slots.select(F.col("id").alias("slot_id"),
                        (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("slot_idx"))


def slot_split(members: DataFrame, slots: DataFrame, n_members: int, n_slots: int) -> DataFrame:
    """G3 + G7 inputs: eligible members with ``rank0``, in-stratum rank ``rk`` and ``slot_id``."""
    cols = [c for c in members.columns if c not in ("bin_id", "slot_id")]
    ranked = ordered_rank(stratum_cols(members.select(*cols)), seat_order(), {"rank0": [], "rk": ["dk", "gk"]})
    ranked = ranked.withColumn("slot_idx", slot_of(F.col("rank0"), n_members, n_slots))
    return ranked.join(slot_index(slots), "slot_idx")  # slot dimension: broadcast by AQE


def strata_counts(split: DataFrame) -> DataFrame:
    """members per (slot, stratum), the stratum's first position in the slot, and the
    number of its members in earlier slots (to turn the in-stratum rank into a slot sequence)."""
    c = split.groupBy("slot_id", "slot_idx", "dk", "gk").agg(
        F.count(F.lit(1)).alias("n_k"), F.min("rank0").alias("first_pos"))
    w = Window.partitionBy("dk", "gk").orderBy("slot_idx").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("before", F.coalesce(F.sum("n_k").over(w), F.lit(0)).cast("long"))


def seat_slots(members: DataFrame, bins: DataFrame, slots: DataFrame,
               target_group: str | None = None, check_capacity: bool = True) -> DataFrame:
    """Seat eligible members into (bin, slot). Returns (id, bin_id, slot_id, dk, gk).

    Raises ``CapacityExceededError`` (J8) when seats over all slots are fewer than members.
    """
    rep = kpi.capacity_report(members, bins, slots, target_group)
    if check_capacity and not rep.is_sufficient:
        raise CapacityExceededError(rep.total_members, rep.total_capacity)
    spark = members.sparkSession
    empty = spark.createDataFrame([], "id long, bin_id long, slot_id long, dk long, gk string")
    if rep.total_members == 0 or rep.n_slots == 0:
        return empty
    n, s = rep.total_members, rep.n_slots
    elig = kpi.eligible_for_seating(members, target_group)
    split = slot_split(elig, slots, n, s)
    strata = strata_counts(split)
    q, r = divmod(n, s)
    sizes = ([q + 1] if r else []) + ([q] if q else [])
    tg = apportion.bin_targets(bins, sizes)
    slot_sizes = slot_index(slots).withColumn(
        "n", F.when(F.col("slot_idx") < r, q + 1).otherwise(q).cast("long")).where(F.col("n") > 0)
    targets = slot_sizes.join(tg, "n").select("slot_id", "bin_id", "target")
    cells = apportion.strata_matrix(targets, strata)
    # (slot, stratum) rows: counted once so the table joined to member rows is broadcast
    small = strata.count() <= BROADCAST_ROW_LIMIT
    return assign_ranges(split, strata, cells, small_strata=small)


def assign_ranges(split: DataFrame, strata: DataFrame, cells: DataFrame, small_strata: bool = False) -> DataFrame:
    """Member (slot, stratum, seq) -> the cell whose [lo, hi) holds seq.

    Bucket width per (slot, stratum) = ceil(n_k / cells of that stratum), so the exploded
    quota table has about 2 x cells rows and each member meets ~2 candidate cells.
    """
    ncell = cells.groupBy("slot_id", "dk", "gk").agg(F.count(F.lit(1)).alias("_cells"))
    st = (strata.join(ncell, ["slot_id", "dk", "gk"], "left")
          .withColumn("_w", F.greatest(F.lit(1), F.ceil(F.col("n_k") / F.coalesce(F.col("_cells"), F.lit(1))))
                      .cast("long"))
          .select("slot_id", "dk", "gk", "before", "_w"))
    # the per-(slot, stratum) table: broadcast when its size was checked, else AQE decides
    m = (split.join(F.broadcast(st) if small_strata else st, ["slot_id", "dk", "gk"])
         .withColumn("_seq", F.col("rk") - F.col("before"))
         .withColumn("_b", F.floor(F.col("_seq") / F.col("_w")).cast("long")))
    q = (cells.join(st.select("slot_id", "dk", "gk", "_w"), ["slot_id", "dk", "gk"])
         .withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_w")).cast("long"),
                                                F.floor((F.col("hi") - 1) / F.col("_w")).cast("long"))))
         .select("slot_id", "dk", "gk", "_b", F.col("bin_id").alias("_bin"), "lo", "hi"))
    j = m.join(q, ["slot_id", "dk", "gk", "_b"]).where((F.col("_seq") >= F.col("lo")) & (F.col("_seq") < F.col("hi")))
    return j.select("id", F.col("_bin").alias("bin_id"), "slot_id", "dk", "gk")


def apply_seats(members: DataFrame, seats: DataFrame, now=None) -> DataFrame:
    """Write seats back: members with bin_id, slot_id and ``bin_allocated_at`` from ``seats`` (a key join on id).

    The time is that of the run for seated members, and what it was (or null) for others.
    """
    now = ntz_lit(now) if now is not None else F.localtimestamp()
    s = seats.select("id", F.col("bin_id").alias("_nb"), F.col("slot_id").alias("_ns"), F.lit(True).alias("_hit"))
    kept = F.col("bin_allocated_at") if "bin_allocated_at" in members.columns else F.lit(None)
    return (members.join(s, "id", "left")
            .withColumn("bin_id", F.coalesce(F.col("_nb"), F.col("bin_id")))
            .withColumn("slot_id", F.coalesce(F.col("_ns"), F.col("slot_id")))
            .withColumn("bin_allocated_at", F.when(F.col("_hit"), now).otherwise(kept).cast("timestamp_ntz"))
            .drop("_nb", "_ns", "_hit"))


def balance_report(members: DataFrame, seats: DataFrame, bins: DataFrame) -> DataFrame:
    """Per (slot, bin, department): seated members, the department's share in the bin vs
    its share in the slot, the bin's fill vs capacity and an over-capacity flag."""
    s = seats.select("id", "slot_id", "bin_id", "dk")
    cell = s.groupBy("slot_id", "bin_id", "dk").agg(F.count(F.lit(1)).alias("n"))
    wb = Window.partitionBy("slot_id", "bin_id")
    ws = Window.partitionBy("slot_id", "dk")
    wt = Window.partitionBy("slot_id")
    cap = bins.select(F.col("id").alias("bin_id"), "capacity")
    out = (cell.withColumn("bin_n", F.sum("n").over(wb).cast("long"))
           .withColumn("slot_dept_n", F.sum("n").over(ws).cast("long"))
           .withColumn("slot_n", F.sum("n").over(wt).cast("long"))
           .join(cap, "bin_id", "left"))
    return out.select(
        "slot_id", "bin_id", F.col("dk").alias("department_key"), F.col("n").cast("long").alias("n"),
        "bin_n", "slot_dept_n", "slot_n", "capacity",
        F.round(F.col("n") / F.col("bin_n"), 6).alias("share_in_bin"),
        F.round(F.col("slot_dept_n") / F.col("slot_n"), 6).alias("share_in_slot"),
        (F.col("bin_n") > F.col("capacity")).alias("over_capacity"))


# ------------------------------------------------------------------------ cohort seating
def venue_list(spark, venues: list[tuple[str, int]] | None = None):
    """Venues configured inline, in list order; default one ``Auditorium`` of 500 seats."""
    venues = venues or [("Auditorium", 500)]
    return local_frame(spark, [(i, n, int(c)) for i, (n, c) in enumerate(venues)],
                       "ord long, name string, capacity long")


def cohort_members(members: DataFrame, cohort: str) -> DataFrame:
    return members.where(~F.coalesce(F.col("is_deleted"), F.lit(False)) & (F.col("status") == "Active")
                         & (F.col("group_name") == cohort))


def seat_cohort(members: DataFrame, venues: DataFrame, cohort: str | None = None) -> DataFrame:
    """J7 (G8 + G9): one bin per member of a cohort, mixing departments and genders.

    Rule: members in usn order are split by stratum (department or 0, gender or "Unknown"); for
    venues in list order (capacity > 0 only), stratum k takes its next
    ``max(1, int(N_k * (cap_v / total_cap)))`` members; what is left of a stratum goes round-robin
    over the venues (``(i - shares) mod V``). No capacity guard (quirk Q10: bins can overfill).

    ``venues``: (ord, name, capacity). Returns (id, bin_name, dk, gk). Stratum k can reach at most
    min(V, N_k) venues (each share is >= 1), so its venue rows are generated per stratum from an
    index sequence and equi-joined to the venues on ``ord`` -- at most one row per member.
    """
    grp = cohort if cohort and cohort != "All" else "Group A"
    v = venues.where(F.col("capacity") > 0)
    v = v.select((F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("ord"), "name", "capacity")
    nv = v.agg(F.count(F.lit(1))).scalar()
    total = v.agg(F.sum("capacity")).scalar()
    m = stratum_cols(cohort_members(members, grp))
    ranked = ordered_rank(m, [F.col("usn"), F.col("id")], {"seq": ["dk", "gk"]})
    strata = ranked.groupBy("dk", "gk").agg(F.count(F.lit(1)).alias("n_k"))
    # strata = departments x genders; counting them bounds the per-stratum tables joined to the
    # member rows below, which are then broadcast (a hot stratum never meets a shuffle join)
    small = strata.count() <= BROADCAST_ROW_LIMIT
    bc = F.broadcast if small else (lambda d: d)
    reach = strata.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"),
                                                          (F.least(nv, F.col("n_k")) - 1).cast("long"))))
    sh = reach.join(v, "ord")
    share = F.greatest(F.lit(1), F.floor(F.col("n_k") * (F.col("capacity") / total))).cast("long")
    w = Window.partitionBy("dk", "gk").orderBy("ord")
    sh = (sh.withColumn("_share", share)
          .withColumn("hi", F.sum("_share").over(w.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("lo", F.col("hi") - F.col("_share"))
          .withColumn("hi", F.least(F.col("hi"), F.col("n_k")))
          .where(F.col("lo") < F.col("hi")))
    cells = sh.select(F.lit(0).cast("long").alias("slot_id"), "dk", "gk", F.col("ord").alias("bin_id"), "lo", "hi")
    taken = cells.groupBy("dk", "gk").agg(F.max("hi").alias("_taken"))
    strata_t = strata.select(F.lit(0).cast("long").alias("slot_id"), "dk", "gk", "n_k",
                             F.lit(0).cast("long").alias("before"))
    split_ = ranked.withColumn("slot_id", F.lit(0).cast("long")).withColumnRenamed("seq", "rk")
    split_ = split_.join(bc(taken), ["dk", "gk"], "left").withColumn("_taken", F.coalesce("_taken", F.lit(0)))
    in_range = assign_ranges(split_.where(F.col("rk") < F.col("_taken")), strata_t, cells, small_strata=small) \
        .select("id", F.col("bin_id").alias("ord"), "dk", "gk")
    leftover = (split_.where(F.col("rk") >= F.col("_taken"))
                .select("id", F.pmod(F.col("rk") - F.col("_taken"), F.lit(nv)).cast("long").alias("ord"), "dk", "gk"))
    out = in_range.unionByName(leftover).join(v.select("ord", F.col("name").alias("bin_name")), "ord")
    return out.select("id", "bin_name", "dk", "gk").withColumn("group_name", F.lit(grp))


def event_facts(assigned: DataFrame, events: list[str] | DataFrame) -> DataFrame:
    """The same bin for every configured event -- one fact per (member, event).

    ``events`` is a table with ``event_name``, joined whatever its size, or a short list, exploded
    in place. Without events there is one, "Event 1".
    """
    who = [F.col("id").alias("member_id"), F.col("event_name"), F.col("bin_name"), F.col("group_name")]
    if isinstance(events, DataFrame) and not events.isEmpty():
        return assigned.crossJoin(events.select(strip(F.col("event_name")).alias("event_name"))).select(*who)
    names = [e.strip() for e in events] if isinstance(events, list) else []
    names = names or ["Event 1"]
    return assigned.withColumn("event_name", F.explode(F.array(*[F.lit(n) for n in names]))).select(*who)


def replace_facts(prior: DataFrame, members: DataFrame, cohort: str, new: DataFrame) -> DataFrame:
    """Drop earlier facts of the cohort's current members (anti join), add the new ones.

    Kept facts keep their id and time; new ones get ids above every earlier id, by member and
    event, and no time, so the result feeds the event reports as the stored facts do."""
    ids = cohort_members(members, cohort).select(F.col("id").alias("member_id"))
    columns = ["id", "member_id", "event_name", "bin_name", "group_name", "created_at"]
    keep = prior.join(ids, "member_id", "left_anti").select(*columns)
    base = prior.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one number
    numbered = ordered_rank(new.select("member_id", "event_name", "bin_name", "group_name"), [F.col("member_id"), F.col("event_name")])
    added = numbered.select((F.col("rank0") + base + 1).cast("long").alias("id"), "member_id", "event_name", "bin_name", "group_name",
                            F.lit(None).cast(prior.schema["created_at"].dataType).alias("created_at"))
    return keep.unionByName(added)


def seat_result(members: DataFrame, seats: DataFrame, target_group: str | None = None) -> DataFrame:
    """F12 for seating: members considered and newly seated (one row)."""
    considered = kpi.eligible_for_seating(members, target_group).agg(F.count(F.lit(1))).scalar()
    return seats.agg(F.count(F.lit(1)).alias("newly_allocated_bins")).select(
        considered.alias("total_processed"), F.lit(0).cast("long").alias("newly_allocated_groups"),
        "newly_allocated_bins", F.lit(0).cast("long").alias("skipped_existing"))
