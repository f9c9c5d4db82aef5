"""File import end to end: files -> header mapping -> batch -> upsert -> ledger and audit rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.operators import mapping
from seatwise.operators.rank import ordered_rank
from seatwise.operators.upsert import apply_mapping, upsert
from seatwise.operators.util import local_frame, ntz_lit
from seatwise.sources import files


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an upload under their canonical columns, with ``row_no`` (1-based, by file name and
    place in the file).

    Files that share a header line are mapped and read together, other header lines on their own.
    Only header lines pass the driver; a column that a file lacks is null.
    """
    files.check_kind(path)
    groups = files.roster_groups(spark, path)
    if not groups:
        raise files.ValidationError(f"no roster file in {path}")
    headers = local_frame(spark, [(str(g), p, h) for g, (hs, _) in enumerate(groups) for p, h in enumerate(hs)],
                          "file string, pos long, header string")
    chosen: dict[int, dict[str, str]] = {}
    for r in mapping.map_headers(headers).collect():  # at most one row per field and header line
        chosen.setdefault(int(r["file"]), {})[r["header"]] = r["field"]
    parts = []
    for g, (_, df) in enumerate(groups):
        names = chosen.get(g, {})
        parts.append(apply_mapping(df.select(*[F.col(f"`{h}`") for h in names], "source_file", "_line"), names))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ranked = ordered_rank(rows, [F.col("source_file"), F.col("_line")])
    return ranked.withColumn("row_no", (F.col("rank0") + 1).cast("long")).drop("rank0", "source_file", "_line")


def free_id(ledger: DataFrame, wanted: int) -> int:
    """``wanted``, or the number after the ledger's last id where an import has taken it."""
    last, taken = ledger.agg(F.max("id"), F.count_if(F.col("id") == wanted)).first()
    return last + 1 if taken else wanted


def import_files(spark: SparkSession, path: str, target: DataFrame, dept: DataFrame, program: DataFrame,
                 ledger: DataFrame, import_id: int, now, batch_tag: str = "0") -> dict[str, DataFrame]:
    """Import an upload (one CSV file or workbook, or a folder of them) into the member table.

    Returns what ``upsert`` returns, with "ledger" the ledger plus this import's row (id, name,
    hash, counts, time) and "audit" the audit row. The hash of a folder is that of its files' sorted
    hashes. An id that the ledger already holds is refused before anything is read.
    """
    if ledger.where(F.col("id") == import_id).limit(1).count():
        raise ValueError(f"import {import_id} is already in the ledger")
    out = upsert(read_batch(spark, path), target, dept, program, import_id, now=now, batch_tag=batch_tag)
    prints = F.sort_array(F.collect_list("file_hash"))
    hashed = files.fingerprint(spark, path).where(files.suffix(F.col("path")).isin(".csv", ".xlsx")).agg(
        F.when(F.size(prints) == 1, prints[0]).otherwise(F.sha2(F.array_join(prints, "\n"), 256)).alias("h"))
    done = out["ledger"].select(
        F.lit(import_id).cast("long").alias("id"), F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("file_name"),
        hashed.scalar().alias("file_hash"), F.coalesce("total_rows", F.lit(0)).alias("total_rows"), "new_records",
        F.coalesce("updated_records", F.lit(0)).alias("updated_records"), "duplicate_records",
        ntz_lit(now).cast(ledger.schema["imported_at"].dataType).alias("imported_at"))
    audit = done.select(
        F.lit("IMPORT_COMPLETED").alias("action"), F.lit("Import").alias("entity_type"),
        F.col("id").cast("string").alias("entity_id"),
        F.format_string("%d rows: %d new, %d updated", "total_rows", "new_records", "updated_records").alias("details"),
        F.col("imported_at").alias("created_at"))
    return out | {"ledger": ledger.unionByName(done), "audit": audit}
