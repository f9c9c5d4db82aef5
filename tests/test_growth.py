"""Steps of the stream and snapshot queries that must not cost more than their input: uploads, label state, table differences."""

import os
import random
from collections import Counter
from decimal import Decimal
from glob import glob

from pyspark.sql import functions as F

from seatwise.operators import snapshot, upsert
from seatwise.streaming import ingest, kpi


def test_uploads_are_one_file_each_in_order_of_arrival(spark):
    root = snapshot.scratch_root(spark, "test-uploads")
    rows = [(k, f"U{k}") for k in range(3, 33)]
    random.Random(2).shuffle(rows)
    batch = spark.createDataFrame([*rows, (None, "none")], "row_no long, usn string").repartition(5)
    ingest.write_uploads(batch, f"{root}/in", 4)
    local = root.removeprefix("file:")
    found = sorted(glob(f"{local}/in/*/*.csv"), key=os.path.getmtime)
    assert len({os.path.getmtime(f) for f in found}) == len(found) == 4
    got = [sorted(int(x.split(",")[0]) for x in open(f).read().split()[1:]) for f in found]
    assert got == [list(range(3, 11)), list(range(11, 19)), list(range(19, 27)), list(range(27, 33))]


def test_keys_of_an_upsert_from_given_first_rows(spark):
    clean = spark.createDataFrame([(1, "A", "X"), (2, "A", "Y"), (3, "B", "Y"), (4, "C", "Z")], "row_no long, ukey string, ikey string")
    target = spark.createDataFrame([(7, "C", "q")], "id long, usn string, student_id string")
    firsts = spark.createDataFrame([("A", 1, "X"), ("B", 3, "Y"), ("C", 4, "Z")], "ukey string, first long, ikey string")
    want = sorted(map(tuple, upsert.resolve_keys(clean, target).collect()))
    assert sorted(map(tuple, upsert.resolve_keys(clean, target, firsts=firsts).collect())) == want
    assert want == [("A", 1, True), ("B", 1, True), ("C", 7, False)]


def test_label_state_follows_the_micro_batch(spark):
    root = snapshot.scratch_root(spark, "test-labels")
    schema, last = "turn long, member string, label string", {}
    parts = [[(k, f"m{k}", "A") for k in range(40)], [(40, "m1", "B"), (41, "m1", "B"), (42, "m2", None), (0, "m3", "late")], [(43, "m1", ""), (44, "new", "B")],
             [(50 + k, f"m{k}", "C") for k in range(30)]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/log/part_{n}")
        v = kpi.changes_stream(spark, f"{root}/log/*", schema, "member", "label", "turn", f"{root}/sink", f"{root}/ckpt")
        last |= {m: x for _, m, x in rows if x != "late"}
        assert {r["label"]: r["n"] for r in spark.read.parquet(f"{root}/sink/v={v}").collect()} == dict(Counter(x for x in last.values() if x))
    state = root.removeprefix("file:") + "/sink/_state"
    assert [spark.read.parquet(f"{state}/delta={n}").count() for n in (1, 2, 3, 4)] == [40, 2, 2, 30]
    assert sorted(os.path.basename(x) for x in glob(f"{state}/base=*")) == ["base=1", "base=4"]
    assert spark.read.parquet(f"{state}/base=4").count() == 41


def test_differing_rows_are_counted_as_often_as_they_differ(spark):
    rng = random.Random(4)
    for _ in range(3):
        a, b = ([(rng.choice([1, 2, None]), rng.choice(["x", None])) for _ in range(n)] for n in (30, 22))
        left, right = (spark.createDataFrame(x, "k long, `a.b` string") for x in (a, b))
        both = (Counter(a) - Counter(b)) + (Counter(b) - Counter(a))
        assert snapshot.differing(left, right).first()["rows"] == sum(both.values())
    assert snapshot.differing(left.limit(0), left.limit(0)).first()["rows"] == 0


def test_sums_of_hashes_are_those_of_whole_numbers(spark):
    df = spark.range(500).select((F.col("id") % 60).alias("k"), F.col("id").cast("string").alias("v"))
    hashes = [r[0] for r in df.select(snapshot._row_hash(df, 1)).collect()]
    assert df.agg(snapshot._sum_hash(df, 1)).first()[0] == Decimal(sum(hashes)) and min(hashes) < 0 < max(hashes)
    assert df.limit(0).agg(snapshot._sum_hash(df)).first()[0] == 0
