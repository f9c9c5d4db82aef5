"""Apportionment of seats: G4 (bins of one slot) and G5 (bins x strata matrix).

Both work on dimension-sized tables (bins, strata, slots), never on member rows. Doubles are
computed in the original operation order, because tie order depends on the exact remainders:
G4 ``capacity * (count / total)``, G5 ``(T_v * N_k) / N``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bin_targets(bins: DataFrame, counts: list[int]) -> DataFrame:
    """Largest-remainder split of ``n`` members over active bins in proportion to capacity.

    Returns (``n``, bin_id, capacity, target) for every requested ``n``. Rules: ratio =
    min(1, n / total capacity); base = min(floor(capacity * ratio), capacity); the deficit goes one
    seat each to bins still below capacity by remainder desc, capacity desc, id asc; a zero total
    or n = 0 gives zeros. One pass suffices because the deficit never exceeds the number of bins
    with a positive remainder. ``counts`` is the short list of distinct slot sizes (at most two
    for an even slot split), exploded in place, so the table has bins x len(counts) rows.
    """
    b = (bins.where(F.col("is_active") & (F.col("capacity") > 0))
         .select(F.col("id").alias("bin_id"), "capacity")
         .withColumn("n", F.explode(F.array(*[F.lit(int(c)).cast("long") for c in sorted(set(counts))]))))
    wn = Window.partitionBy("n")
    total = F.sum("capacity").over(wn)
    ratio = F.least(F.lit(1.0), F.col("n") / F.col("_total"))
    b = (b.withColumn("_total", total)
         .withColumn("_exact", F.col("capacity") * ratio)
         .withColumn("_base", F.least(F.floor(F.col("_exact")).cast("long"), F.col("capacity")))
         .withColumn("_rem", F.col("_exact") - F.col("_base"))
         .withColumn("_deficit", F.col("n") - F.sum("_base").over(wn))
         .withColumn("_open", F.col("_base") < F.col("capacity")))
    wr = Window.partitionBy("n", "_open").orderBy(F.col("_rem").desc(), F.col("capacity").desc(), F.col("bin_id"))
    b = b.withColumn("_r", F.row_number().over(wr))
    plus = F.when(F.col("_open") & (F.col("_r") <= F.col("_deficit")), 1).otherwise(0)
    target = F.when((F.col("_total") == 0) | (F.col("n") == 0), F.lit(0)).otherwise(F.col("_base") + plus)
    return b.select("n", "bin_id", "capacity", target.cast("long").alias("target"))


def matrix_fold(targets: pd.DataFrame, strata: pd.DataFrame) -> pd.DataFrame:
    """G5 for one slot: bins x strata counts whose row sums are the bin targets and column sums
    the stratum sizes, plus each cell's [lo, hi) range of stratum sequence numbers (G6).

    ``targets``: slot_id, bin_id, target. ``strata``: slot_id, dk, gk, n_k, first_pos.
    Rule: cell = floor(T_v * N_k / N); then, by remainder desc (ties: bin id, stratum first-seen
    order), +1 while both the bin's and the stratum's deficits are positive; then a residual
    sweep over bins in id order giving each missing seat to the first stratum still short.
    Inherently sequential, but over cells of one slot only (bins x strata), never members.
    """
    cols = ["slot_id", "bin_id", "dk", "gk", "n", "lo", "hi"]
    if targets.empty or strata.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64" if c != "gk" else "object") for c in cols})
    slot = int(targets["slot_id"].iloc[0] if not targets.empty else strata["slot_id"].iloc[0])
    t = targets.sort_values("bin_id", kind="stable")
    s = strata.sort_values("first_pos", kind="stable")
    tv = t["target"].to_numpy(dtype=np.int64)
    nk = s["n_k"].to_numpy(dtype=np.int64)
    total = int(nk.sum())
    if total == 0 or len(tv) == 0:
        return pd.DataFrame({c: [] for c in cols})
    exact = (tv[:, None] * nk[None, :]) / total
    base = np.floor(exact).astype(np.int64)
    rem = exact - base
    row_def = tv - base.sum(axis=1)
    col_def = nk - base.sum(axis=0)
    need = int(row_def.sum())
    nv, nkk = base.shape
    if need > 0:
        order = np.argsort(-rem.ravel(), kind="stable")  # ties keep (bin, stratum) order
        for flat in order:
            v, k = divmod(int(flat), nkk)
            if row_def[v] > 0 and col_def[k] > 0:
                base[v, k] += 1
                row_def[v] -= 1
                col_def[k] -= 1
                need -= 1
                if need == 0:
                    break
    for v in range(nv):  # residual sweep (needed when remainders are exhausted at zero)
        while row_def[v] > 0:
            open_k = np.nonzero(col_def > 0)[0]
            if len(open_k) == 0:
                break
            k = int(open_k[0])
            base[v, k] += 1
            row_def[v] -= 1
            col_def[k] -= 1
    hi = np.cumsum(base, axis=0)  # running quota per stratum over bin order (G6)
    lo = hi - base
    vv, kk = np.nonzero(base > 0)
    return pd.DataFrame({
        "slot_id": np.full(len(vv), slot, dtype=np.int64),
        "bin_id": t["bin_id"].to_numpy(dtype=np.int64)[vv],
        "dk": s["dk"].to_numpy(dtype=np.int64)[kk],
        "gk": s["gk"].to_numpy(dtype=object)[kk],
        "n": base[vv, kk],
        "lo": lo[vv, kk],
        "hi": hi[vv, kk],
    })


MATRIX_SCHEMA = "slot_id long, bin_id long, dk long, gk string, n long, lo long, hi long"


def strata_matrix(targets: DataFrame, strata: DataFrame) -> DataFrame:
    """G5/G6 for all slots: cogroup the per-slot bin targets with the per-slot strata and fold.

    One Python call per slot; each receives bins + strata rows of that slot, and the matrix is
    formed inside it, so no bins x strata pair table exists on the Spark side.
    """
    t = targets.select("slot_id", "bin_id", "target")
    s = strata.select("slot_id", "dk", "gk", "n_k", "first_pos")
    return t.groupBy("slot_id").cogroup(s.groupBy("slot_id")).applyInPandas(matrix_fold, MATRIX_SCHEMA)
