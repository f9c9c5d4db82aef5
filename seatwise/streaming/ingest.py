"""K1: incremental roster ingest as a Structured Streaming job.

Each arriving CSV upload (file source, one file per micro-batch so uploads stack in arrival
order) is upserted onto the current roster with ``operators.upsert``. A table of the state is a base and
the deltas since: ``<store>/<table>/base=<n>`` and ``delta=<n>``, the latter with only the rows that micro-batch changed, so what
a micro-batch writes follows its own size and not the roster's. Readers take the last delta of an id, else the base.
Once the deltas hold a quarter of the base's rows, the next micro-batch writes a new base beside its delta.

``<store>/_versions/v=<n>`` names the base and the deltas of version n and is written last. Micro-batch ``e`` reads
the newest version up to ``e`` and writes version ``e + 1``, so a replayed micro-batch (foreachBatch is
at-least-once) writes the same files over from the same input -- exactly-once effect. The stream
checkpoint tracks which files were taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.operators import upsert

TABLES = ("members", "dept", "program")
VERSION = "version long, base long, deltas array<long>, delta_rows long, base_rows long"
COMPACT = 0.25  # of the base's rows


def init_store(store: str, members: DataFrame, dept: DataFrame, program: DataFrame) -> None:
    """Version 0 of the state."""
    for name, df in zip(TABLES, (members, dept, program)):
        df.write.mode("overwrite").parquet(f"{store}/{name}/base=0")
    spark = members.sparkSession
    rows = spark.read.parquet(f"{store}/members/base=0").count()
    _publish(spark, store, 0, 0, [], 0, rows)


def _publish(spark: SparkSession, store: str, version: int, base: int, deltas: list[int], delta_rows: int, base_rows: int) -> None:
    spark.createDataFrame([(version, base, deltas, delta_rows, base_rows)], VERSION).coalesce(1).write.mode("overwrite").parquet(f"{store}/_versions/v={version}")


def _version(spark: SparkSession, store: str, version: int):
    return spark.read.schema(VERSION).parquet(f"{store}/_versions/v={version}").first()


def read_version(spark: SparkSession, store: str, version: int) -> dict[str, DataFrame]:
    """The tables of a version: of each id the row of its last delta, else the base's."""
    v = _version(spark, store, version)
    out = {}
    for name in TABLES:
        base = spark.read.parquet(f"{store}/{name}/base={v['base']}")
        if not v["deltas"]:
            out[name] = base
            continue
        changed = spark.read.schema(base.schema).option("basePath", f"{store}/{name}").parquet(*[f"{store}/{name}/delta={d}" for d in v["deltas"]])
        own = F.struct(*[F.col(f"`{c}`") for c in base.columns])
        last = changed.groupBy(F.col("id").alias("_id")).agg(F.max_by(own, "delta").alias("_row")).select("_row.*")
        out[name] = base.join(last.select("id"), "id", "left_anti").select(*base.columns).unionByName(last)
    return out


def latest_version(spark: SparkSession, store: str, at_most: int | None = None) -> int:
    """Highest complete version (optionally not above ``at_most``); -1 when none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{store}/_versions")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    best = -1
    for st in fs.listStatus(p) if fs.exists(p) else ():
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            v = int(name[2:])
            if at_most is None or v <= at_most:
                best = max(best, v)
    return best


def write_changes(spark: SparkSession, store: str, epoch: int, changed: dict[str, DataFrame]) -> None:
    """Version ``epoch + 1``: the deltas of a micro-batch and, when those since the base have grown, a new base."""
    before = _version(spark, store, latest_version(spark, store, at_most=epoch))
    new = epoch + 1
    for name in TABLES:
        changed[name].write.mode("overwrite").parquet(f"{store}/{name}/delta={new}")
    rows = before["delta_rows"] + spark.read.parquet(f"{store}/members/delta={new}").count()
    deltas = [*before["deltas"], new]
    _publish(spark, store, new, before["base"], deltas, rows, before["base_rows"])
    if rows > COMPACT * before["base_rows"]:
        state = read_version(spark, store, new)
        for name in TABLES:
            state[name].write.mode("overwrite").parquet(f"{store}/{name}/base={new}")
        _publish(spark, store, new, new, [], 0, spark.read.parquet(f"{store}/members/base={new}").count())


def run_ingest(spark: SparkSession, input_dir: str, schema: str, store: str, checkpoint: str,
               first_import_id: int, batch_tag: str = "0", now=None) -> int:
    """Run the stream over everything available, then stop. Returns the final version."""

    def apply(batch: DataFrame, epoch: int) -> None:
        if batch.limit(1).count() == 0:
            return
        # state before this micro-batch: the newest version written by an earlier one
        cur = read_version(spark, store, latest_version(spark, store, at_most=epoch))
        res = upsert.upsert(batch, cur["members"], cur["dept"], cur["program"],
                            import_id=first_import_id + epoch, now=now, batch_tag=batch_tag)
        # written before the next micro-batch reads it: files, not this lineage
        write_changes(spark, store, epoch, {
            "members": res["members"].where(F.col("import_id") == first_import_id + epoch), "dept": res["new_dept"], "program": res["new_program"]})

    stream = (spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", 1)
              .csv(f"{input_dir}/*/*.csv"))
    q = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_version(spark, store)


def write_uploads(batch: DataFrame, input_dir: str, n_files: int) -> None:
    """Test helper: split a batch into ``n_files`` uploads by row_no range, each one CSV file
    (as a user upload is). One job writes them; their times are then set in row order, which is their order of arrival."""
    bounds = batch.agg(F.min("row_no"), F.max("row_no")).first()
    lo, hi = int(bounds[0]), int(bounds[1])
    step = max(1, -(-(hi - lo + 1) // n_files))
    spark = batch.sparkSession
    (batch.where("row_no is not null").withColumn("_upload", F.floor((F.col("row_no") - lo) / step)).repartitionByRange(n_files, "_upload")
     .write.mode("overwrite").partitionBy("_upload").option("header", True).csv(f"{input_dir}/_uploads"))
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(input_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.getFileStatus(path(f"{input_dir}/_uploads/_SUCCESS")).getModificationTime()
    for k in range(n_files):
        to = path(f"{input_dir}/upload_{k:04d}")
        fs.delete(to, True)
        if not fs.rename(path(f"{input_dir}/_uploads/_upload={k}"), to):
            continue  # no rows
        for f in fs.globStatus(path(to, "*.csv")):
            at = done - 1000 * (n_files - k)
            fs.setTimes(f.getPath(), at, -1)
            if fs.getFileStatus(f.getPath()).getModificationTime() != at:
                raise OSError(f"{input_dir} does not keep the times of files")
    fs.delete(path(f"{input_dir}/_uploads"), True)
