"""Ordered row numbers without a single-partition window.

``row_number() OVER (ORDER BY ...)`` and ``ntile`` without PARTITION BY move every row into one
task, and ``PARTITION BY dept`` puts a hot department (a third of all rows) into one task. The
two-phase rank avoids both:

1. range-partition on (group cols, order cols) and sort inside partitions; tag each row with its
   partition id ``_rank_p`` and its position ``_rank_i`` inside the partition;
2. write that frame once as parquet into the shared checkpoint folder and read it back, so
   partition ids and positions are fixed facts that cannot change if an executor is lost and a
   stage is recomputed (and the lineage is cut);
3. count rows per (partition, group) -- a table of at most partitions + groups rows when the
   group columns lead the sort, partitions x groups otherwise -- reading two or three columns;
4. prefix-sum the counts per group over partition order and add the offset back. When the count
   table is small (checked: collected with a row limit) the offsets are computed on the driver
   and shipped as a broadcast local table; otherwise a distributed window + join does it.

Ranges never split a row's order: keys are unique because callers end the order with ``id``. Columns of
its own begin with ``_rank_``; callers may have any others.
"""

from __future__ import annotations

import uuid
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.operators.util import local_frame
from seatwise.session import ensure_checkpoint_dir

LOCAL_OFFSETS_LIMIT = 50_000  # count tables up to this many rows are prefix-summed on the driver


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back (lineage cut,
    recomputation-proof). The cluster's ``spark.checkpoint.dir`` must be a shared folder."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/seatwise-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def range_sorted(df: DataFrame, order: list, num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned, partition-sorted, materialised copy of ``df`` with ``_rank_p`` and ``_rank_i``.

    ``order`` items are column names or expressions; they are materialised as ``_rank_o<k>``.
    """
    spark = df.sparkSession
    # at least as many ranges as the input has splits (maxPartitionBytes-sized), so a range
    # partition's sort stays bounded however large the input grows
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    keys = [f"_rank_o{k}" for k in range(len(order))]
    tagged = df.withColumns({k: _as_col(c) for k, c in zip(keys, order)})
    ranged = (tagged.repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_rank_p", F.spark_partition_id())
              .withColumn("_rank_i", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    return materialise(ranged, "rank")


def _local_offsets(rows: list[tuple], ncols: int, contiguous: bool) -> list[tuple]:
    """Prefix sums per group over partition order, on a collected count table.

    Row layout: (_rank_p, *group values, _rank_n[, _rank_start]).
    """
    def gkey(r):
        return tuple(r[1:1 + ncols])

    out = []
    ordered = sorted(rows, key=lambda r: (repr(gkey(r)), r[0]))
    for _g, rs in groupby(ordered, key=lambda r: repr(gkey(r))):
        acc = 0
        for r in rs:
            out.append((r[0], *gkey(r), acc) + ((r[2 + ncols],) if contiguous else ()))
            acc += r[1 + ncols]
    return out


def add_ranks(ranged: DataFrame, groups: dict[str, list[str]], lead: list[str] = ()) -> DataFrame:
    """Add one 0-based rank column per entry of ``groups`` to a ``range_sorted`` frame.

    ``groups`` maps output column -> group columns ([] = global rank). ``lead`` are the group
    columns the frame was sorted by first: a group that is a prefix of them is contiguous inside
    a partition, so its local position needs no window.
    """
    spark = ranged.sparkSession
    out = ranged
    for name, cols in groups.items():
        cols = list(cols)
        contiguous = cols == list(lead)[:len(cols)]
        if contiguous:
            local = F.col("_rank_i") - F.col("_rank_start")
            aggs = [F.count(F.lit(1)).alias("_rank_n"), F.min("_rank_i").alias("_rank_start")]
        else:
            out = out.withColumn("_rank_loc", F.row_number().over(Window.partitionBy("_rank_p", *cols).orderBy("_rank_i")) - 1)
            local = F.col("_rank_loc")
            aggs = [F.count(F.lit(1)).alias("_rank_n")]
        counts = ranged.groupBy("_rank_p", *cols).agg(*aggs)
        gk = [f"_rank_g{k}" for k in range(len(cols))]
        rows = counts.limit(LOCAL_OFFSETS_LIMIT + 1).collect()
        if len(rows) <= LOCAL_OFFSETS_LIMIT:
            fields = [T.StructField("_rank_p", T.IntegerType())]
            fields += [T.StructField(g, ranged.schema[c].dataType) for c, g in zip(cols, gk)]
            fields += [T.StructField("_rank_off", T.LongType())]
            if contiguous:
                fields += [T.StructField("_rank_start", T.LongType())]
            data = _local_offsets([tuple(r) for r in rows], len(cols), contiguous)
            offs = F.broadcast(local_frame(spark, data, T.StructType(fields)))  # size checked above
        else:
            w = Window.partitionBy(*cols).orderBy("_rank_p").rowsBetween(Window.unboundedPreceding, -1)
            offs = counts.withColumn("_rank_off", F.coalesce(F.sum("_rank_n").over(w), F.lit(0))).drop("_rank_n")
            offs = offs.select("_rank_p", *[F.col(c).alias(g) for c, g in zip(cols, gk)], "_rank_off",
                               *(["_rank_start"] if contiguous else []))
        cond = [out["_rank_p"] == offs["_rank_p"]] + [out[c].eqNullSafe(offs[g]) for c, g in zip(cols, gk)]
        out = (out.join(offs, cond).drop(offs["_rank_p"]).drop(*gk)
               .withColumn(name, (F.col("_rank_off") + local).cast("long"))
               .drop("_rank_off", "_rank_start", "_rank_loc"))
    return out


def ordered_rank(df: DataFrame, order: list, groups: dict[str, list[str]] | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """``df`` plus 0-based row numbers in ``order``, globally and/or inside groups.

    Equivalent to ``row_number() OVER (PARTITION BY g ORDER BY order) - 1`` for each entry of
    ``groups`` (default: one global ``rank0``), but no stage holds more than one range
    partition of rows, whatever the key skew.
    """
    groups = groups if groups is not None else {"rank0": []}
    # Sort by the group columns every grouping shares first: groups equal to that prefix are
    # contiguous inside a partition (no window); the others rank with a bounded window.
    sets = [list(g) for g in groups.values()]
    lead = [c for c in sets[0] if all(c in g for g in sets[1:])] if sets else []
    ranged = range_sorted(df, [F.col(c) for c in lead] + list(order), num_partitions)
    out = add_ranks(ranged, groups, lead=lead)
    return out.drop(*[c for c in out.columns if c.startswith("_rank_")])


SMALL_RANK_LIMIT = 10_000


def _sort_key(vals):
    return tuple((0,) if v is None else (1, v) for v in vals)  # ascending, nulls first


def small_rank(df: DataFrame, order: list, limit: int = SMALL_RANK_LIMIT, name: str = "rank0") -> DataFrame:
    """``ordered_rank`` for dimension-sized inputs (new department codes, new bins).

    The order keys (unique, as everywhere) are collected with a row limit; within the limit the
    ranks are computed on the driver and broadcast back by key (one job instead of three).
    Beyond the limit it falls back to the distributed two-phase rank, so nothing unbounded ever
    reaches the driver.
    """
    spark = df.sparkSession
    keys = [f"_rank_o{k}" for k in range(len(order))]
    tagged = df.withColumns({k: _as_col(c) for k, c in zip(keys, order)})
    rows = tagged.select(*keys).limit(limit + 1).collect()
    if len(rows) > limit:
        return ordered_rank(df, order, {name: []})
    ranked = sorted((tuple(r) for r in rows), key=_sort_key)
    schema = T.StructType([T.StructField(f"_rank_k{k}", tagged.schema[c].dataType) for k, c in enumerate(keys)]
                          + [T.StructField(name, T.LongType())])
    local = F.broadcast(local_frame(spark, [r + (i,) for i, r in enumerate(ranked)], schema))
    cond = [tagged[c].eqNullSafe(local[f"_rank_k{k}"]) for k, c in enumerate(keys)]
    out = tagged.join(local, cond)
    return out.drop(*keys, *[f"_rank_k{k}" for k in range(len(keys))])
