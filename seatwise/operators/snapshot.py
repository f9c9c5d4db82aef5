"""Table snapshots by content (B7-B10) and the audit trail.

A table is cut into buckets by the hash of its first column, and a bucket's files are named by a
digest of its rows: ``<root>/data/<table>/<bucket>-<digest>``. A snapshot is the list of the buckets it
refers to, appended to ``<root>/_manifest`` (outside the data, fix of Q3: a restore doesn't lose the history), so a bucket that
an earlier snapshot holds isn't written again: a snapshot of an unchanged state costs one scan and its manifest rows.

Data is written to a folder of the run, then renamed to its names, then the manifest rows are
appended in one job. A crash before that leaves files that no manifest names; the next snapshot takes
the next number and writes what it needs. ``commit`` and ``restore_state`` set the current state by appending to
``<root>/_current``: a pointer, so that restoring copies nothing. ``root`` must be a shared folder on a cluster.
"""

from __future__ import annotations

import datetime
import json
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.session import ensure_checkpoint_dir

#: One row a bucket; an empty table has one row with bucket -1.
REFERENCE_SCHEMA = ("snapshot string, seq long, table string, columns string, bucket long, digest string, rows long, checksum decimal(38,0), "
                    "trigger string, live_members long, created_at timestamp_ntz")
CURRENT_SCHEMA = "turn long, snapshot string, at timestamp_ntz"
BUCKET_ROWS = 200_000


class SnapshotError(Exception):
    """Missing snapshot or checksum mismatch."""


def scratch_root(spark: SparkSession, name: str = "snapshots") -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/seatwise-{name}-{uuid.uuid4().hex[:12]}"


def _row_hash(df: DataFrame, seed: int = 0):
    """A hash of a row's values with their columns' names and nulls."""
    parts = [x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(F.lit(seed), *parts)


def _sum_hash(df: DataFrame, seed: int = 0):
    """Sum of row hashes, whatever the rows' order; equal rows don't cancel.

    The upper and the lower half are summed as longs, which is exact to 2^31 rows (beyond, the sum raises) and far cheaper than decimals."""
    h = _row_hash(df, seed)
    high, low = F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.coalesce(high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(20,0)"), F.lit(0)).cast("decimal(38,0)")


def checksum(df: DataFrame) -> DataFrame:
    """One row: (rows, checksum) of a table, independent of row order and partitioning."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.pmod(_sum_hash(df), F.lit(2 ** 63 - 25).cast("decimal(20,0)")).cast("long").alias("checksum"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(f"`{df.columns[0]}`")), F.lit(buckets)))


def _digests(df: DataFrame) -> DataFrame:
    """(_bucket, rows, checksum, digest) of a bucketed table: two independent sums of row hashes and the columns."""
    own = df.drop("_bucket")
    d = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("rows"), _sum_hash(own).alias("checksum"), _sum_hash(own, 1).alias("other"))
    named = F.concat_ws(":", F.lit(own.schema.simpleString()), "rows", "checksum", "other")
    return d.select("_bucket", "rows", "checksum", F.substring(F.sha2(named, 256), 1, 32).alias("digest"))


def references(spark: SparkSession, root: str) -> DataFrame:
    """All buckets that snapshots refer to."""
    path = f"{root}/_manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], REFERENCE_SCHEMA)
    return spark.read.schema(REFERENCE_SCHEMA).parquet(path)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per table of each snapshot."""
    return references(spark, root).groupBy("snapshot", "seq", "table", "trigger", "live_members", "created_at").agg(
        F.sum("rows").alias("rows"), F.pmod(F.sum("checksum"), F.lit(2 ** 63 - 25).cast("decimal(20,0)")).cast("long").alias("checksum"))


def _place(root: str, table: str, bucket, digest) -> str:
    return f"{root}/data/{table}/{bucket}-{digest}"


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame], trigger: str,
           members_table: str = "members", bucket_rows: int = BUCKET_ROWS) -> str:
    """Write the buckets that the store lacks, then the snapshot's references. Returns the snapshot id."""
    known = references(spark, root)
    seq = (known.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] or 0) + 1
    snap = f"{seq:06d}"
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    live = None
    if members_table in tables:
        m = tables[members_table]
        live = m.where(~F.coalesce(F.col("is_deleted"), F.lit(False))).count() if "is_deleted" in m.columns else m.count()
    rows = []
    for name, df in tables.items():
        n = df.count()
        buckets = 1
        while buckets * bucket_rows < n:  # a power of two: a table that grows seldom moves its rows
            buckets *= 2
        cut = _bucketed(df, buckets)
        found = _digests(cut).collect()  # a row a bucket
        held = {(r["bucket"], r["digest"]) for r in known.where(F.col("table") == name).select("bucket", "digest").distinct().collect()}
        fresh = [r for r in found if (r["_bucket"], r["digest"]) not in held or not _exists(spark, _place(root, name, r["_bucket"], r["digest"]))]
        if fresh:
            run = f"{root}/data/{name}/_run-{uuid.uuid4().hex}"
            some = cut if len(fresh) == len(found) else cut.where(F.col("_bucket").isin([r["_bucket"] for r in fresh]))
            some.repartition("_bucket").write.partitionBy("_bucket").parquet(run)
            fs, at = _fs(spark, run)
            for r in fresh:
                _, to = _fs(spark, _place(root, name, r["_bucket"], r["digest"]))
                fs.delete(to, True)  # left by a crash before its manifest
                if not fs.rename(_fs(spark, f"{run}/_bucket={r['_bucket']}")[1], to):
                    raise SnapshotError(f"cannot name a bucket of {name}")
            fs.delete(at, True)
        about = (trigger, live, now)
        rows += [(snap, seq, name, df.schema.json(), r["_bucket"], r["digest"], r["rows"], r["checksum"], *about) for r in found] or [
            (snap, seq, name, df.schema.json(), -1, "", 0, Decimal(0), *about)]
    spark.createDataFrame(rows, REFERENCE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/_manifest")
    return snap


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Manifest newest first, with a flag telling whether each table's files still exist (one listing of names)."""
    fs, pattern = _fs(spark, f"{root}/data/*/*-*")
    there = [(s.getPath().getParent().getName(), s.getPath().getName()) for s in fs.globStatus(pattern) or []]
    held = spark.createDataFrame(there, "table string, name string").withColumn("held", F.lit(True))
    refs = references(spark, root).withColumn("name", F.concat_ws("-", "bucket", "digest"))
    ex = refs.join(held, ["table", "name"], "left").groupBy("snapshot", "table").agg(F.every(F.coalesce("held", F.col("bucket") < 0)).alias("exists"))
    return read_manifest(spark, root).join(ex, ["snapshot", "table"]).orderBy(F.col("seq").desc(), "table")


def _of(spark: SparkSession, root: str, snap: str) -> dict[str, list]:
    found: dict[str, list] = {}
    for r in references(spark, root).where(F.col("snapshot") == snap).orderBy("table", "bucket").collect():
        found.setdefault(r["table"], []).append(r)
    if not found:
        raise SnapshotError(f"snapshot {snap} not found")
    return found


def _read(spark: SparkSession, root: str, refs: list) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(refs[0]["columns"]))
    paths = [_place(root, r["table"], r["bucket"], r["digest"]) for r in refs if r["bucket"] >= 0]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, root: str, snap: str) -> dict[str, DataFrame]:
    """The tables of a snapshot."""
    return {name: _read(spark, root, refs) for name, refs in _of(spark, root, snap).items()}


def verify(spark: SparkSession, root: str, snap: str) -> DataFrame:
    """(table, rows, rows_now, ok); digests are taken again from the files, one job a table."""
    out = []
    for name, refs in _of(spark, root, snap).items():
        rows = sum(r["rows"] for r in refs)
        if not all(r["bucket"] < 0 or _exists(spark, _place(root, name, r["bucket"], r["digest"])) for r in refs):
            out.append((name, rows, None, False))
            continue
        if not rows:
            out.append((name, 0, 0, True))
            continue
        whole = _read(spark, root, refs)
        place = F.element_at(F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "-"), 1).cast("long")
        now = {r["_bucket"]: r for r in _digests(whole.withColumn("_bucket", place)).collect()}
        kept = {r["bucket"]: r["digest"] for r in refs if r["bucket"] >= 0}
        out.append((name, rows, sum(r["rows"] for r in now.values()), {b: r["digest"] for b, r in now.items()} == kept))
    return spark.createDataFrame(out, "table string, rows long, rows_now long, ok boolean")


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row, ``rows``: the rows that one of two tables has more often than the other, counted as often (one shuffle for both sides)."""
    signed = left.withColumn("_sign", F.lit(1)).union(right.withColumn("_sign", F.lit(-1)))
    odd = signed.groupBy(*[f"`{c}`" for c in left.columns]).agg(F.sum("_sign").alias("_sign"))
    return odd.agg(F.coalesce(F.sum(F.abs("_sign")), F.lit(0)).alias("rows"))


def restore(spark: SparkSession, root: str, snap: str, current: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Verify (a mismatch is an error), take a safety snapshot of the current state, then return the
    snapshot's tables."""
    if verify(spark, root, snap).where(~F.col("ok")).count():
        raise SnapshotError("snapshot checksum mismatch: the snapshot may be corrupted")
    create(spark, root, current, "PRE_ROLLBACK_AUTO_SAVE")
    return read_snapshot(spark, root, snap)


def _point(spark: SparkSession, root: str, snap: str) -> None:
    path = f"{root}/_current"
    turn = 1 + (spark.read.schema(CURRENT_SCHEMA).parquet(path).agg(F.max("turn")).first()[0] or 0) if _exists(spark, path) else 1
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(turn, snap, now)], CURRENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current state."""
    if not _exists(spark, f"{root}/_current"):
        raise SnapshotError("no state was committed")
    last = spark.read.schema(CURRENT_SCHEMA).parquet(f"{root}/_current").agg(F.max_by("snapshot", "turn")).first()[0]
    return read_snapshot(spark, root, last)


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], trigger: str) -> str:
    """Make ``tables`` the current state; what they share with earlier snapshots isn't written again."""
    snap = create(spark, root, tables, trigger)
    _point(spark, root, snap)
    return snap


def restore_state(spark: SparkSession, root: str, snap: str) -> str:
    """B10 whole: verify, save the current state, point to the snapshot and log it. Returns the saved state's snapshot."""
    refs = _of(spark, root, snap)
    if verify(spark, root, snap).where(~F.col("ok")).count():
        raise SnapshotError("snapshot checksum mismatch: the snapshot may be corrupted")
    saved = create(spark, root, current(spark, root), "PRE_ROLLBACK_AUTO_SAVE")
    _point(spark, root, snap)
    at = next(iter(refs.values()))[0]["created_at"]
    append(audit_rows(spark, [("DATABASE_RESTORED", "Backup", snap, f"Restored to snapshot {snap} of {at:%Y-%m-%d %H:%M:%S}")]), f"{root}/_audit")
    return saved


# ----------------------------------------------------------------------------------------- audit
AUDIT_SCHEMA = "action string, entity_type string, entity_id string, details string, created_at timestamp_ntz"


def audit_rows(spark: SparkSession, events: list[tuple[str, str, str | None, str]]) -> DataFrame:
    """Audit rows for (action, entity_type, entity_id, details) of finished operations."""
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(a, t, i, d, now) for a, t, i, d in events], AUDIT_SCHEMA)


def audit_from_metrics(metrics: DataFrame, action: str, entity_type: str, template: str) -> DataFrame:
    """B5 built on the executors from a one-row metrics frame: ``template`` is a
    ``format_string`` pattern over the metric columns in order."""
    cols = metrics.columns
    return metrics.select(F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"),
                          F.lit(None).cast("string").alias("entity_id"),
                          F.format_string(template, *[F.col(c) for c in cols]).alias("details"),
                          F.current_timestamp().cast("timestamp_ntz").alias("created_at"))


def append(df: DataFrame, path: str) -> None:
    """Append-only write (audit trail, import ledger)."""
    df.write.mode("append").parquet(path)
