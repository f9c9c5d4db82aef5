"""Scale-up run: the sf0.1 roster and bins replicated k times (ids and names made unique per copy),
then the cohort split and the slot seating, each run to completion. Prints one JSON line per k.

Usage: python scripts/scaleup.py [sf_dir] [k ...]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from seatwise.operators import seating, split  # noqa: E402
from seatwise.session import get_spark  # noqa: E402
from seatwise.sources import testdata as td  # noqa: E402


def replicate(df, k: int, id_step: int, text_cols: list[str]):
    rep = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    out = rep.withColumn("id", F.col("id") + F.col("_rep").cast("long") * id_step)
    for c in text_cols:
        out = out.withColumn(c, F.concat(F.col(c), F.lit("~"), F.col("_rep").cast("string")))
    return out.drop("_rep")


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    ks = [int(a) for a in args if not a.startswith("/")] or [1, 10, 100]
    spark = get_spark("local[8]", shuffle_partitions=16,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="seatwise-scale-")})
    m0, b0, s0 = td.member(spark, sf), td.bins(spark, sf), td.slots(spark, sf)
    m0.write.format("noop").mode("overwrite").save()  # warm-up
    for k in ks:
        m = replicate(m0, k, 10_000_000, ["usn", "student_id", "full_name"])
        b = replicate(b0, k, 10_000_000, ["name"])
        t = time.time()
        split.split_cohorts(m, fresh=True).write.format("noop").mode("overwrite").save()
        t_split = time.time() - t
        t = time.time()
        seats = seating.seat_slots(m, b, s0)
        seats.write.format("noop").mode("overwrite").save()
        t_seat = time.time() - t
        print(json.dumps({"replicas": k, "members": 15000 * k, "split_sec": round(t_split, 2),
                          "seat_sec": round(t_seat, 2)}), flush=True)


if __name__ == "__main__":
    main()
