"""Roster import: clean (C3-C8), match (E3), upsert (J3), ledger counts.

Sequential rule being reproduced, per batch row in file order: the row's member is the one the
usn-key map points to, else the one the id-key map points to (maps start from the stored members,
last in scan order = highest id wins a shared key), else a new member; afterwards both maps point
the row's keys at that member. Updates overwrite usn, student_id, full_name, department, gender
and set Active / not deleted / this import; program, student_number, created_at, cohort and
placement are kept. Inserts take program and student_number from their first row.

Set-based form: a forest over usn keys. Once a usn key has a member it keeps it, so every row has the
member of the first row of its usn key. That first row takes the stored member of the usn key; else
the member of the last earlier row with its id key -- another usn key, whose first row is earlier still; else
the stored member of the id key; else it is a new member, named by its row number. So each usn key
either knows its member or points to one earlier usn key, and the pointers are followed by doubling
them: O(log n) joins for a chain of n keys. Rows are reduced to one per usn key (partial
aggregation) before they meet their member, so neither a hot usn key nor a hot id key gathers rows in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.functions import text as T
from seatwise.operators import dims
from seatwise.operators.rank import materialise, ordered_rank
from seatwise.operators.util import ntz_lit, strip

def apply_mapping(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename mapped headers; a missing department column comes from program, else 'General'."""
    df = raw.withColumnsRenamed({k.strip(): v for k, v in mapping.items() if k.strip() in raw.columns})
    if "department" not in df.columns:
        df = df.withColumn("department", F.col("program") if "program" in df.columns else F.lit("General"))
    return df


def clean_batch(batch: DataFrame, batch_tag: str = "0") -> DataFrame:
    """C4-C8 per row: trimmed text, mutual usn / student_id fill, surrogate keys, fallbacks,
    gender canonicalised, and the two upper-case match keys. ``row_no`` is 1-based file order.

    ``batch_tag`` replaces the clock-derived tag of the surrogate key so reruns are repeatable.
    """
    def col(c):
        return T.cell(F.col(c)) if c in batch.columns else F.lit(None).cast("string")

    def txt(c):
        return F.coalesce(strip(col(c)), F.lit(""))

    usn0, sid0 = txt("usn"), txt("student_id")
    usn1 = F.when((usn0 == "") & (sid0 != ""), sid0).otherwise(usn0)
    sid1 = F.when((usn0 == "") & (sid0 != ""), sid0).when((sid0 == "") & (usn0 != ""), usn0).otherwise(sid0)
    surrogate = F.format_string("STU_%s_%04d", F.lit(str(batch_tag)), F.col("row_no"))
    bad_usn = T.is_missing_token(usn1)
    usn = F.when(bad_usn, surrogate).otherwise(usn1)
    sid = F.when(bad_usn, surrogate).otherwise(sid1)
    name0 = txt("full_name")
    dept0 = txt("department")
    prog = F.when(col("program").isNull(), F.lit("B.Tech")).otherwise(strip(col("program")))
    return batch.select(
        "row_no",
        usn.alias("usn"), sid.alias("student_id"),
        F.when(T.is_missing_token(name0), usn).otherwise(name0).alias("full_name"),
        F.when(T.is_missing_token(dept0), F.lit("General")).otherwise(dept0).alias("department"),
        prog.alias("program"),
        T.canon_gender(col("gender")).alias("gender"),
        strip(col("student_number")).alias("student_number"),
    ).withColumns({"ukey": F.upper(F.col("usn")), "ikey": F.upper(F.col("student_id"))})


def stored_keys(target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key maps of the stored members (deleted ones included): key -> highest id."""
    u = (target.where(F.col("usn").isNotNull()).groupBy(F.upper(strip(F.col("usn"))).alias("ukey"))
         .agg(F.max("id").alias("t_u")))
    i = (target.where(F.col("student_id").isNotNull()).groupBy(F.upper(strip(F.col("student_id"))).alias("ikey"))
         .agg(F.max("id").alias("t_i")))
    return u, i


def match(clean: DataFrame, target: DataFrame) -> DataFrame:
    """Per batch row, the stored member by usn key, else by id key (two equi-joins)."""
    u, i = stored_keys(target)
    m = clean.join(u, "ukey", "left").join(i, "ikey", "left")
    return m.withColumn("matched_id", F.coalesce("t_u", "t_i")).withColumn(
        "matched_by", F.when(F.col("t_u").isNotNull(), "usn").when(F.col("t_i").isNotNull(), "student_id"))


CHUNK = 1 << 16  # rows of an id key that one window holds


def previous_keys(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(row_no, parent): the usn key of the last earlier row with the same id key, where there is one.

    An id key's rows are cut by row number into chunks; a chunk's first row looks at the last row of the
    key's chunk before, so a key that half of the rows share is spread over the cluster.
    """
    cut = rows.withColumn("_chunk", F.floor(F.col("row_no") / chunk))
    last = cut.groupBy("ikey", "_chunk").agg(F.max_by("ukey", "row_no").alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy("ikey").orderBy("_chunk"))).drop("_last")
    near = cut.withColumn("_near", F.lag("ukey").over(Window.partitionBy("ikey", "_chunk").orderBy("row_no")))
    return (near.join(last, ["ikey", "_chunk"]).select("row_no", F.coalesce("_near", "_before").alias("parent"))
            .where(F.col("parent").isNotNull()))


def _follow(nodes: DataFrame) -> DataFrame:
    """(ukey, entity, is_new) of (ukey, parent, entity, is_new), where a row without ``entity`` has its parent's."""
    keep = ["ukey", "entity", "is_new"]
    done, open_ = [nodes.where("entity is not null").select(keep)], nodes.where("entity is null").select("ukey", "parent")
    while not open_.isEmpty():
        known = [d.select(F.col("ukey").alias("parent"), F.lit(None).cast("string").alias("up"), "entity", "is_new") for d in done]
        above = open_.select(F.col("ukey").alias("parent"), F.col("parent").alias("up"), F.lit(None).cast("long").alias("entity"),
                             F.lit(None).cast("boolean").alias("is_new"))
        hop = materialise(open_.join(reduce(DataFrame.unionByName, known, above), "parent").select("ukey", F.col("up").alias("parent"), "entity", "is_new"),
                          "upsert-hop")
        done.append(hop.where("entity is not null").select(keep))
        open_ = hop.where("entity is null").select("ukey", "parent")
    return reduce(DataFrame.unionByName, done)


def resolve_keys(clean: DataFrame, target: DataFrame, chunk: int = CHUNK, firsts: DataFrame | None = None) -> DataFrame:
    """(ukey, entity, is_new) of every usn key of the cleaned batch: ``entity`` is a stored id, or
    the row number that names a new member. ``firsts``: (ukey, first, ikey) of each usn key's first row, where the caller has them."""
    u, i = stored_keys(target)
    if firsts is None:
        firsts = clean.groupBy("ukey").agg(F.min("row_no").alias("first"), F.min_by("ikey", "row_no").alias("ikey"))
    nodes = firsts.join(u, "ukey", "left")
    shared = materialise(clean.groupBy("ikey").agg(F.min("ukey").alias("a"), F.max("ukey").alias("b")).where("a <> b").select("ikey"), "upsert-shared")
    fresh = F.coalesce("t_i", "first").cast("long").alias("entity"), F.col("t_i").isNull().alias("is_new")
    if shared.isEmpty():  # no id key joins two usn keys: every key stands alone
        return nodes.join(i, "ikey", "left").select(
            "ukey", F.coalesce("t_u", fresh[0]).alias("entity"), (F.col("t_u").isNull() & fresh[1]).alias("is_new"))
    rows = clean.select("row_no", "ukey", "ikey").join(shared, "ikey", "left_semi")
    linked = materialise(nodes.join(previous_keys(rows, chunk).withColumnRenamed("row_no", "first"), "first", "left"), "upsert-nodes")
    none = F.lit(None).cast("string").alias("parent")
    known = linked.where("t_u is not null").select("ukey", none, F.col("t_u").cast("long").alias("entity"), F.lit(False).alias("is_new"))
    child = linked.where("t_u is null and parent is not null").select("ukey", "parent", F.lit(None).cast("long").alias("entity"), F.lit(None).cast("boolean").alias("is_new"))
    # without an earlier row a node has its id key for itself
    root = linked.where("t_u is null and parent is null").join(i, "ikey", "left").select("ukey", none, *fresh)
    return _follow(materialise(known.unionByName(child).unionByName(root), "upsert-forest"))


def upsert(batch: DataFrame, target: DataFrame, dept: DataFrame, program: DataFrame, import_id: int,
           now=None, batch_tag: str = "0") -> dict[str, DataFrame]:
    """Returns {"members": member table after the import, "new_dept", "new_program",
    "keys": the member of every usn key, "ledger": one-row counts}."""
    now = ntz_lit(now) if now is not None else F.localtimestamp()
    # cleaned once and written: every later branch reads columns, not the cleaning expressions
    clean = materialise(clean_batch(batch, batch_tag), "upsert-clean")
    dmap, new_dept = dims.spelling_map(clean.select("row_no", F.col("department").alias("name")), dept)
    pmap, new_prog = dims.spelling_map(clean.select("row_no", F.col("program").alias("name")), program)
    # a row per usn key, once for all that follows: the last row's values and the first row's
    by_key = materialise(clean.groupBy("ukey").agg(
        F.max_by(F.struct("usn", "student_id", "full_name", "department", "gender"), "row_no").alias("_over"),
        F.min_by(F.struct("program", "student_number", "ikey"), "row_no").alias("_once"),
        F.min("row_no").alias("_first"), F.max("row_no").alias("_last"), F.count(F.lit(1)).alias("_rows"))
        .select("ukey", "_over.*", "_once.*", "_first", "_last", "_rows"), "upsert-keys")
    keys = resolve_keys(clean, target, firsts=by_key.select("ukey", F.col("_first").alias("first"), "ikey"))
    # spelling -> id maps hold one row per distinct spelling (AQE broadcasts them)
    dmap = dmap.select(F.col("_s_name").alias("_dn"), F.col("dim_id").alias("department_id"))
    pmap = pmap.select(F.col("_s_name").alias("_pn"), F.col("dim_id").alias("program_id"))
    named = (by_key.join(dmap, by_key["department"].eqNullSafe(dmap["_dn"]), "left")
             .join(pmap, by_key["program"].eqNullSafe(pmap["_pn"]), "left").drop("_dn", "_pn"))
    over = ("usn", "student_id", "full_name", "department_id", "gender")
    once = ("program_id", "student_number")
    per = named.join(keys, "ukey").groupBy("entity", "is_new").agg(
        F.max_by(F.struct(*over), "_last").alias("_over"), F.min_by(F.struct(*once), "_first").alias("_once"),
        F.min("_first").alias("_first"), F.sum("_rows").alias("_rows")).select("entity", "is_new", "_over.*", "_once.*", "_first", "_rows")
    # one row per member touched; written once so the update and insert branches (and the
    # insert numbering's sample + write) read it instead of re-running the whole resolution
    per = materialise(per, "upsert-entities")
    upd = (per.where(~F.col("is_new"))
           .select(F.col("entity").alias("id"), *[F.col(c).alias(f"_n_{c}") for c in over])
           .withColumn("_hit", F.lit(True)))
    t = target.join(upd, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    fixed = {"status": F.lit("Active"), "is_deleted": F.lit(False),
             "import_id": F.lit(import_id).cast("long"), "updated_at": now}
    sel = []
    for c in target.columns:
        if c in over:
            sel.append(F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c))
        elif c in fixed:
            sel.append(F.when(hit, fixed[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c))
        else:
            sel.append(F.col(c))
    updated_members = t.select(*sel)
    base = target.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ins = ordered_rank(per.where(F.col("is_new")), [F.col("_first")])
    defaults = {c: F.lit(None).cast(target.schema[c].dataType) for c in target.columns}
    defaults.update({
        "id": (base + F.col("rank0") + 1).cast("long"), "usn": F.col("usn"), "student_id": F.col("student_id"),
        "student_number": F.col("student_number"), "full_name": F.col("full_name"), "gender": F.col("gender"),
        "status": F.lit("Active"), "department_id": F.col("department_id").cast("long"),
        "program_id": F.col("program_id").cast("long"), "import_id": F.lit(import_id).cast("long"),
        "is_deleted": F.lit(False)})
    for c in ("created_at", "updated_at"):
        if c in target.columns:
            defaults[c] = now
    inserted = ins.select(*[defaults[c].alias(c) for c in target.columns])
    members = updated_members.unionByName(inserted)
    ledger = per.agg(F.sum("_rows").cast("long").alias("total_rows"),
                     F.count_if(F.col("is_new")).alias("new_records"))
    ledger = ledger.select("total_rows", "new_records",
                           (F.col("total_rows") - F.col("new_records")).alias("updated_records"),
                           F.lit(0).cast("long").alias("duplicate_records"))
    return {"members": members, "new_dept": new_dept, "new_program": new_prog, "keys": keys, "ledger": ledger}
