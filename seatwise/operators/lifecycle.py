"""Lifecycle operators: import undo (J9, E9, E11), bin / slot delete with set-null (J10, E12),
reset (B11). All return new DataFrames; callers persist them as a new table version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAND_SECONDS = 120


class UnknownImportError(LookupError):
    """No ledger row has the import's id."""


def _epoch_s(c):
    """Whole seconds since 1970-01-01 of a timestamp_ntz, with no session time zone involved
    (a zone-dependent cast could shift buckets across a daylight-saving change)."""
    t = F.col(c)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def time_band_pairs(ledger: DataFrame, members: DataFrame, seconds: int = BAND_SECONDS) -> DataFrame:
    """(import_id, member_id) for members created within +-``seconds`` of each import.

    A band join made equi: time is cut into buckets of ``seconds``; each import meets the three
    buckets its band can touch, then the exact inclusive band is checked. Work grows with the
    pairs produced, never with imports x members.
    """
    w = float(seconds)
    imp = (ledger.select(F.col("id").alias("import_id"), F.col("imported_at"))
           .withColumn("_b", F.explode(F.sequence(F.floor((_epoch_s("imported_at") - w) / w).cast("long"),
                                                  F.floor((_epoch_s("imported_at") + w) / w).cast("long")))))
    mem = (members.select(F.col("id").alias("member_id"), "created_at")
           .where(F.col("created_at").isNotNull())
           .withColumn("_b", F.floor(_epoch_s("created_at") / w).cast("long")))
    lo = F.col("imported_at") - F.make_dt_interval(secs=F.lit(seconds))
    hi = F.col("imported_at") + F.make_dt_interval(secs=F.lit(seconds))
    return (imp.join(mem, "_b").where((F.col("created_at") >= lo) & (F.col("created_at") <= hi))
            .select("import_id", "member_id"))


def members_of_import(members: DataFrame, ledger: DataFrame, import_id: int) -> DataFrame:
    """J9 membership rule for one import: linked members; if none, all members when this is the
    only import, else those created within +-120 s of it. Returns member ids.

    Raises ``UnknownImportError`` when the ledger doesn't hold the import: nothing is then undone."""
    if ledger.where(F.col("id") == import_id).limit(1).count() == 0:
        raise UnknownImportError(f"import {import_id} is not in the ledger")
    linked = members.where(F.col("import_id") == import_id).select(F.col("id").alias("member_id"))
    if linked.limit(1).count() > 0:
        return linked
    if ledger.limit(2).count() == 1:
        return members.select(F.col("id").alias("member_id"))
    one = ledger.where(F.col("id") == import_id)
    return time_band_pairs(one, members).select("member_id").distinct()


def undo_import(members: DataFrame, facts: DataFrame, ledger: DataFrame, import_id: int) -> dict[str, DataFrame]:
    """Hard-delete the import's members, cascade to their facts, drop the ledger row."""
    gone = members_of_import(members, ledger, import_id)
    return {
        "members": members.join(gone.withColumnRenamed("member_id", "id"), "id", "left_anti"),
        "facts": facts.join(gone, "member_id", "left_anti"),
        "ledger": ledger.where(F.col("id") != import_id),
        "removed": gone,
    }


def delete_bins(members: DataFrame, bins: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Remove bins and null the placement of members seated in them (all rows).

    ``ids``: one column ``id`` of bins to delete (a small set; semi/anti joins, no collect).
    """
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    m = members.join(gone, members["bin_id"] == gone["_gone"], "left")
    hit = F.col("_gone").isNotNull()
    sets = {"bin_id": F.when(hit, F.lit(None).cast("long")).otherwise(F.col("bin_id"))}
    if "bin_allocated_at" in members.columns:
        sets["bin_allocated_at"] = F.when(hit, F.lit(None)).otherwise(F.col("bin_allocated_at"))
    return {"members": m.withColumns(sets).drop("_gone"),
            "bins": bins.join(gone, bins["id"] == gone["_gone"], "left_anti")}


def delete_slots(members: DataFrame, slots: DataFrame, ids: DataFrame, clear_bin: bool = False) -> dict[str, DataFrame]:
    """J10/E12 for slots. Default keeps the original (quirk Q7): the member's bin stays set, so it
    is never seated again; ``clear_bin=True`` clears it too."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    m = members.join(gone, members["slot_id"] == gone["_gone"], "left")
    hit = F.col("_gone").isNotNull()
    sets = {"slot_id": F.when(hit, F.lit(None).cast("long")).otherwise(F.col("slot_id"))}
    if clear_bin:
        sets["bin_id"] = F.when(hit, F.lit(None).cast("long")).otherwise(F.col("bin_id"))
    if "bin_allocated_at" in members.columns:
        sets["bin_allocated_at"] = F.when(hit, F.lit(None)).otherwise(F.col("bin_allocated_at"))
    return {"members": m.withColumns(sets).drop("_gone"),
            "slots": slots.join(gone, slots["id"] == gone["_gone"], "left_anti")}


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Facts, members, ledger, slots and bins emptied (same schemas); departments, programs,
    audit and snapshots survive."""
    cleared = {"facts", "members", "ledger", "slots", "bins"}
    return {k: (v.limit(0) if k in cleared else v) for k, v in tables.items()}
