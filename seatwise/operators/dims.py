"""Dimension get-or-create (J2/E4) and bin upsert (E5), set-based.

J2 rule: a name reuses an existing row when its derived code equals a stored code, or the name
equals a stored code, or the name equals a stored name (all case-insensitive; first hit = lowest
id). Otherwise a new row is created with the first-seen spelling as its name and the derived code
as its code; later names with the same derived code reuse it. Without explicit codes this is
exactly "group unmatched names by derived code" (the original's uniqueness-suffix branch is never
reached because the lookup before it already matches any equal code). With explicit codes a spelling can meet
a new row by code or by name, so new rows are found greedily in first-seen order, in rounds: a spelling
that no earlier open spelling could match makes a row, and those that an earlier row matches are closed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.functions.text import derive_code
from seatwise.operators.rank import materialise, small_rank
from seatwise.operators.util import local_frame, strip


def spelling_map(names: DataFrame, existing: DataFrame, name_col: str = "name", code_col: str | None = None,
                 order_col: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """Returns (one row per distinct spelling: ``_s_<name_col>`` [, ``_s_<code_col>``], ``dim_id``,
    ``created``; the new dimension rows).

    ``existing``: id, name, code. New ids continue after max(existing id) in first-seen order.
    The rule only depends on the spelling, so every distinct spelling is resolved once (partial
    aggregation collapses millions of rows to the handful of spellings first).
    """
    keys = [name_col] + ([code_col] if code_col else [])
    sp = names.groupBy(*keys).agg(F.min(order_col).alias("_first_raw"))
    n = sp.select(*keys, "_first_raw", strip(F.col(name_col)).alias("_clean"),
                  derive_code(F.col(name_col), F.col(code_col) if code_col else None).alias("_code"))
    ex = existing.select("id", F.lower(F.col("name")).alias("_ln"), F.lower(F.col("code")).alias("_lc"))
    by_code = ex.groupBy(F.col("_lc").alias("_k")).agg(F.min("id").alias("_id"))
    by_name = ex.groupBy(F.col("_ln").alias("_k")).agg(F.min("id").alias("_id"))
    # three equi-lookups instead of one OR-join (which would plan as a nested loop)
    m = (n.join(by_code.withColumnRenamed("_id", "_m1"), F.lower(n["_code"]) == by_code["_k"], "left").drop("_k")
         .join(by_code.withColumnRenamed("_id", "_m2"), F.lower(n["_clean"]) == by_code["_k"], "left").drop("_k")
         .join(by_name.withColumnRenamed("_id", "_m3"), F.lower(n["_clean"]) == by_name["_k"], "left").drop("_k")
         .withColumn("_match", F.least("_m1", "_m2", "_m3")))
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    if code_col:
        return _with_codes(m, keys, base)
    small = _small_spelling_map(m, keys, base)
    if small is not None:
        return small
    fresh = m.where(F.col("_match").isNull())
    groups = fresh.groupBy("_code").agg(F.min_by("_clean", "_first_raw").alias("name"),
                                        F.min("_first_raw").alias("_first"))
    ranked = small_rank(groups, [F.col("_first"), F.col("_code")])  # dimension-sized
    new_dims = ranked.select((base + F.col("rank0") + 1).cast("long").alias("id"), "name",
                             F.col("_code").alias("code"))
    per_spelling = (m.join(new_dims.select(F.col("id").alias("_new"), F.col("code").alias("_code")), "_code", "left")
                    .select(*[F.col(k).alias(f"_s_{k}") for k in keys],
                            F.coalesce("_match", "_new").alias("dim_id"), F.col("_match").isNull().alias("created")))
    return per_spelling, new_dims


def _earliest(rows: DataFrame, among: DataFrame) -> DataFrame:
    """``rows`` with ``_e``: the least ``_first`` of ``among`` that has their code as code, their name as code or their name as name."""
    code = among.groupBy(F.lower("_code").alias("_k")).agg(F.min("_first").alias("_x"))
    name = among.groupBy(F.lower("_clean").alias("_k")).agg(F.min("_first").alias("_x"))
    out = rows
    for n, (table, key) in enumerate(((code, "_code"), (code, "_clean"), (name, "_clean"))):
        own = table.select(F.col("_k").alias(f"_k{n}"), F.col("_x").alias(f"_e{n}"))
        out = out.join(own, F.lower(out[key]) == own[f"_k{n}"], "left").drop(f"_k{n}")
    return out.withColumn("_e", F.least("_e0", "_e1", "_e2")).drop("_e0", "_e1", "_e2")


def _with_codes(m: DataFrame, keys: list[str], base) -> tuple[DataFrame, DataFrame]:
    """``spelling_map`` where codes are given: the rows of the greedy walk, found in rounds over spellings."""
    n = materialise(m.groupBy("_code", "_clean", "_match").agg(F.min("_first_raw").alias("_first")), "spellings")
    n = n.where("_match is null").groupBy(F.lower("_code").alias("_c"), F.lower("_clean").alias("_n")).agg(
        F.min_by(F.struct("_code", "_clean"), "_first").alias("_s"), F.min("_first").alias("_first")).select("_s.*", "_first")
    open_, rows = materialise(n, "spellings-open"), []
    while not open_.isEmpty():
        made = materialise(_earliest(open_, open_).where("_e = _first").select("_code", "_clean", "_first"), "spellings-made")
        rows.append(made)
        open_ = materialise(_earliest(open_, made).where("_e is null or _e > _first").drop("_e"), "spellings-open")
    if not rows:
        rows = [open_]
    made = reduce(DataFrame.unionByName, rows)
    ranked = small_rank(made, [F.col("_first"), F.col("_code")])  # dimension-sized
    new = materialise(ranked.select((base + F.col("rank0") + 1).cast("long").alias("id"), F.col("_clean").alias("name"), F.col("_code").alias("code"), "_first"), "spellings-new")
    # a spelling takes the first new row that its code or name meets; ids grow with _first
    found = _earliest(m.where("_match is null"), new.select(F.col("name").alias("_clean"), F.col("code").alias("_code"), "_first"))
    found = found.join(new.select("id", F.col("_first").alias("_e")), "_e").withColumn("_match", F.lit(None).cast("long"))
    own = [F.col(k).alias(f"_s_{k}") for k in keys]
    per = (m.where("_match is not null").select(*own, F.col("_match").alias("dim_id"), F.lit(False).alias("created"))
           .unionByName(found.select(*own, F.col("id").alias("dim_id"), F.lit(True).alias("created"))))
    return per, new.drop("_first")


SMALL_SPELLINGS = 10_000


def _small_spelling_map(m: DataFrame, keys: list[str], base):
    """When the distinct spellings are few (checked with a row-limited collect), finish the
    rule on the driver -- new codes in first-seen order -- and return both results as local
    broadcast tables, so later plans do not re-run the resolution. ``None`` beyond the limit."""
    spark = m.sparkSession
    rows = (m.select(*keys, "_clean", "_code", "_first_raw", "_match", base.alias("_base"))
            .limit(SMALL_SPELLINGS + 1).collect())
    if len(rows) > SMALL_SPELLINGS:
        return None
    start = int(rows[0]["_base"]) if rows else 0
    first: dict = {}
    for r in rows:
        if r["_match"] is None:
            f = first.get(r["_code"])
            if f is None or r["_first_raw"] < f[0]:
                first[r["_code"]] = (r["_first_raw"], r["_clean"])
    order = sorted(first, key=lambda c: (first[c][0], c))
    new_id = {c: start + i + 1 for i, c in enumerate(order)}
    new_dims = local_frame(spark, [(new_id[c], first[c][1], c) for c in order], "id long, name string, code string")
    fields = [T.StructField(f"_s_{k}", m.schema[k].dataType) for k in keys]
    fields += [T.StructField("dim_id", T.LongType()), T.StructField("created", T.BooleanType())]
    per = [tuple(r[k] for k in keys) + ((r["_match"] if r["_match"] is not None else new_id[r["_code"]]),
                                        r["_match"] is None) for r in rows]
    return F.broadcast(local_frame(spark, per, T.StructType(fields))), F.broadcast(new_dims)


def resolve(names: DataFrame, existing: DataFrame, name_col: str = "name", code_col: str | None = None,
            order_col: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """J2 per input row: (``order_col``, ``dim_id``, ``created``) and the new dimension rows.

    The small spelling -> id table of ``spelling_map`` is joined back to the rows."""
    keys = [name_col] + ([code_col] if code_col else [])
    per_spelling, new_dims = spelling_map(names, existing, name_col, code_col, order_col)
    cond = [names[k].eqNullSafe(per_spelling[f"_s_{k}"]) for k in keys]
    out = names.join(per_spelling, cond).select(order_col, "dim_id", "created")
    return out, new_dims


def upsert_bins(existing: DataFrame, incoming: DataFrame, order_col: str = "row_no") -> DataFrame:
    """E5: bins matched by lower(strip(name)); a match takes the incoming capacity when it
    differs (last incoming row wins); unmatched names are inserted once, first spelling and
    location kept, ids after max(id). Returns the whole bin table after the upsert."""
    inc = incoming.withColumn("_k", F.lower(strip(F.col("name"))))
    agg = inc.groupBy("_k").agg(F.min_by(strip(F.col("name")), order_col).alias("_name"),
                                F.max_by("capacity", order_col).alias("_cap"),
                                F.min_by("location", order_col).alias("_loc"),
                                F.min(order_col).alias("_first"))
    ex = existing.withColumn("_k", F.lower(F.col("name")))
    # stored names are unique case-insensitively in practice; pin a match to the lowest id
    exk = ex.groupBy("_k").agg(F.min("id").alias("_eid"))
    matched = agg.join(exk, "_k", "left")
    upd = matched.where(F.col("_eid").isNotNull()).select(F.col("_eid").alias("id"), "_cap")
    out_ex = (existing.join(upd, "id", "left")
              .withColumn("capacity", F.coalesce(F.col("_cap"), F.col("capacity")).cast("long")).drop("_cap"))
    new = matched.where(F.col("_eid").isNull())
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ranked = small_rank(new, [F.col("_first"), F.col("_k")])  # dimension-sized
    ins = ranked.select((base + F.col("rank0") + 1).cast("long").alias("id"), F.col("_name").alias("name"),
                        F.col("_cap").cast("long").alias("capacity"), F.col("_loc").alias("location"),
                        F.lit(True).alias("is_active"))
    return out_ex.select("id", "name", "capacity", "location", "is_active").unionByName(ins)


def upsert_slots(existing: DataFrame, incoming: DataFrame, order_col: str = "row_no") -> DataFrame:
    """E5: time slots matched by lower(strip(slot_name)) and day; a match is left as it is, others are
    inserted once with the first row's spelling and times, ids after max(id). Returns the whole slot table."""
    inc = incoming.select(F.lower(strip(F.col("slot_name"))).alias("_k"), strip(F.col("slot_name")).alias("slot_name"), "start_time", "end_time",
                          F.coalesce("day_number", F.lit(1)).cast("int").alias("day_number"), F.col(order_col).alias("_at"))
    first = inc.groupBy("_k", "day_number").agg(F.min_by(F.struct("slot_name", "start_time", "end_time"), "_at").alias("_s"), F.min("_at").alias("_first"))
    held = existing.select(F.lower(F.col("slot_name")).alias("_k"), F.col("day_number").cast("int").alias("day_number")).distinct()
    new = first.join(held, ["_k", "day_number"], "left_anti")
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ranked = small_rank(new, [F.col("_first"), F.col("_k"), F.col("day_number")])  # dimension-sized
    ins = ranked.select((base + F.col("rank0") + 1).cast("long").alias("id"), "_s.slot_name", "_s.start_time", "_s.end_time", "day_number")
    return existing.select("id", "slot_name", "start_time", "end_time", F.col("day_number").cast("int").alias("day_number")).unionByName(ins)
