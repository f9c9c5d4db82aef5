"""K2: live counts over an assignment log (Structured Streaming).

``counts_stream`` counts the rows of an append-only log. ``changes_stream`` counts members: its state holds each
member's label, a change takes one from the old label's count and adds one to the new one's, and a
null label takes the member out, so the counts are those of the log's final table at any time. A micro-batch is
reduced to a row a member and joined with the state, a base and deltas of files as in ``ingest``.

``groupBy(label).count()`` runs as a stateful streaming aggregation (state store keyed by the
label, partial aggregation before the shuffle); every micro-batch publishes the full, small
count table to the sink folder. Run with ``availableNow`` to catch up and stop, or with a
processing-time trigger to keep a dashboard fresh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts_stream(spark: SparkSession, log_dir: str, schema: str, label_col: str, missing: str,
                  sink: str, checkpoint: str, available_now: bool = True):
    log = spark.readStream.schema(schema).parquet(log_dir)
    counts = (log.groupBy(F.coalesce(F.when(F.col(label_col) != "", F.col(label_col)), F.lit(missing))
                          .alias(label_col))
              .agg(F.count(F.lit(1)).alias("n")))

    def publish(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(sink)

    w = (counts.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


COMPACT = 0.25  # of the base's rows


def _written(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the complete ``<root>/<kind>=<n>``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def _labels(spark: SparkSession, state: str, version: int, member) -> tuple[DataFrame, int, int]:
    """(member, turn, label) of every member after ``version`` micro-batches, the rows of its base and of the deltas since."""
    schema = f"member {member.simpleString()}, turn long, label string"
    base = max((b for b in _written(spark, state, "base") if b <= version), default=0)
    held = spark.read.schema(schema).parquet(f"{state}/base={base}") if base else spark.createDataFrame([], schema)
    if base == version:
        return held, held.count(), 0
    since = spark.read.schema(schema).parquet(*[f"{state}/delta={n}" for n in range(base + 1, version + 1)])
    last = held.unionByName(since).groupBy("member").agg(F.max(F.struct("turn", "label")).alias("_last"))
    return last.select("member", "_last.*"), held.count(), since.count()


def changes_stream(spark: SparkSession, log_dir: str, schema: str, key_col: str, label_col: str, turn_col: str,
                   sink: str, checkpoint: str, files_per_batch: int | None = None) -> int:
    """Follow a change log (key, label, a turn that grows) to its end; returns the last version of the counts.

    ``<sink>/v=<n>`` holds (label, n) after n micro-batches: the counts before plus the micro-batch's moves. The members' labels are
    ``<sink>/_state/base=<n>`` and the ``delta=<n>`` since, with only the members that a micro-batch changed; deltas
    of a quarter of the base's rows become a new base. A replayed micro-batch writes the same files again.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    label = F.col(label_col).cast("string")
    log = reader.parquet(log_dir).select(F.col(key_col).alias("member"), F.when(label != "", label).alias("label"), F.col(turn_col).cast("long").alias("turn"))
    state, member = f"{sink}/_state", log.schema["member"].dataType

    def publish(df: DataFrame, epoch: int) -> None:
        new = epoch + 1
        held, base_rows, delta_rows = _labels(spark, state, epoch, member)
        last = (df.where("member is not null and turn is not null").groupBy("member").agg(F.max(F.struct("turn", "label")).alias("_last"))
                .select("member", "_last.*"))
        was = held.select("member", F.col("turn").alias("_turn"), F.col("label").alias("was"))
        # rows older than what was seen change nothing
        moved = last.join(was, "member", "left").where("_turn is null or turn > _turn").drop("_turn")
        moved.write.mode("overwrite").parquet(f"{state}/delta={new}")
        moved = spark.read.schema(moved.schema).parquet(f"{state}/delta={new}")
        counts = (moved.where(~F.col("was").eqNullSafe(F.col("label")))
                  .select(F.inline(F.array(F.struct(F.col("was").alias("label"), F.lit(-1).cast("long").alias("n")),
                                           F.struct("label", F.lit(1).cast("long").alias("n")))))
                  .where("label is not null"))
        if epoch:
            counts = counts.unionByName(spark.read.parquet(f"{sink}/v={epoch}"))
        counts.groupBy("label").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{sink}/v={new}")
        if delta_rows + moved.count() > COMPACT * base_rows:
            _labels(spark, state, new, member)[0].write.mode("overwrite").parquet(f"{state}/base={new}")
        done.append(new)

    done: list[int] = []
    q = log.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return done[-1] if done else 0
