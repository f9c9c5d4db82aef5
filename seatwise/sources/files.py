"""File sources: roster files (A1 CSV, A2 workbooks), dispatch by suffix (A3), profile (A4), fingerprint (A5).

All readers keep every column as string (fix of Q1: no numeric inference that would turn ids into
floats). CSV files are read by byte range (``records``), workbooks a file a task (``workbook``); the old
binary ``.xls`` raises a clear error.
"""

from __future__ import annotations

import csv
import hashlib
import io
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.functions import text
from seatwise.operators.rank import materialise
from seatwise.operators.util import strip
from seatwise.sources.records import csv_records
from seatwise.sources.workbook import workbook_rows

SUPPORTED = {".csv": "csv", ".xlsx": "spreadsheet", ".xls": "spreadsheet"}

WHOLE_BYTES = 128 << 20  # of a file that is read as one row


class ValidationError(Exception):
    """Unsupported file or unreadable content."""


def suffix(path_col) -> F.Column:
    """Lower-cased last suffix of a file name ('' when none)."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def suffix_of(path: str) -> str:
    """Lower-cased suffix of a path's last name; '' for a folder."""
    return "." + path.rsplit(".", 1)[-1].lower() if "." in path.rstrip("/").rsplit("/", 1)[-1] else ""


def dispatch(files: DataFrame, path_col: str = "path") -> DataFrame:
    """A3: kind of every file by suffix (csv / spreadsheet / unsupported)."""
    sfx = suffix(F.col(path_col))
    kind = F.when(sfx == ".csv", "csv").when(sfx.isin(".xlsx", ".xls"), "spreadsheet").otherwise("unsupported")
    return files.withColumn("suffix", sfx).withColumn("kind", kind)


def _safe_headers(cells: list[str]) -> list[str]:
    """Header cells, stripped (fix of Q13); an empty one is named by its place, and repeated ones get their place."""
    names = [c.strip() for c in cells]
    low = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if low.count(n.lower()) > 1 else n for k, n in enumerate(names)]


def _grouped(rows: DataFrame, header_of, parse) -> list[tuple[list[str], DataFrame]]:
    """Rows (file, line, ...) of files grouped by their first row: (headers, cells, folders, source_file, ``_line``).

    Only distinct header rows reach the driver. ``header_of`` is the column that holds a row's header, ``parse`` turns it into names
    and ``rows`` into an array of that many cells.
    """
    first = materialise(rows.groupBy("file").agg(F.min_by(header_of, "line").alias("_header"), F.min("line").alias("_first")), "headers")
    out = []
    for r in first.select("_header").distinct().orderBy("_header").collect():
        headers, body = parse(r["_header"])
        own = first.where(F.col("_header") == F.lit(r["_header"])).select("file", "_first")
        df = rows.join(own, "file").where(F.col("line") > F.col("_first"))
        cells = [text.cell(c).alias(h) for h, c in zip(headers, body, strict=True)]
        folders = [F.col(f"folders.`{f.name}`") for f in rows.schema["folders"].dataType.fields if f.name != "_none" and f.name not in headers]
        out.append((headers, df.select(*cells, *folders, F.col("file").alias("source_file"), F.col("line").alias("_line"))))
    return out


def csv_groups(spark: SparkSession, path: str) -> list[tuple[list[str], DataFrame]]:
    """CSV files of a path grouped by their own header line: (headers, rows with the columns of
    partition folders, ``source_file`` and ``_line``, which grows along a file).

    Files of a folder may order columns as they like; files of other kinds are left out. A record with too few or too many cells
    is an error.
    """
    def parse(header):
        names = _safe_headers(next(csv.reader(io.StringIO(header.lstrip("\ufeff")))))
        schema = ", ".join(f"c{k} string" for k in range(len(names)))
        record = F.from_csv("text", schema, {"quote": '"', "escape": '"', "mode": "FAILFAST"})
        return names, [record[f"c{k}"] for k in range(len(names))]

    return _grouped(csv_records(spark, path, not suffix_of(path)), F.col("text"), parse)


def workbook_groups(spark: SparkSession, path: str) -> list[tuple[list[str], DataFrame]]:
    """``csv_groups`` of the first sheets of the ``.xlsx`` files of a path; rows without a cell are no rows."""
    def parse(header):
        names = _safe_headers([x or "" for x in header])
        return names, [F.get("cells", F.lit(k)) for k in range(len(names))]

    rows = materialise(workbook_rows(spark, path), "workbook-rows").withColumn("folders", F.struct(F.lit(None).cast("string").alias("_none")))
    return _grouped(rows, F.col("cells"), parse)


def roster_groups(spark: SparkSession, path: str) -> list[tuple[list[str], DataFrame]]:
    """Groups of all readable files of a path, CSV files first."""
    kind = suffix_of(path)
    return (csv_groups(spark, path) if kind in ("", ".csv") else []) + (workbook_groups(spark, path) if kind in ("", ".xlsx") else [])


def _together(groups: list[tuple[list[str], DataFrame]], path: str) -> DataFrame:
    if not groups:
        raise ValidationError(f"no roster file in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.drop("_line") for _, df in groups])


def read_csv_rosters(spark: SparkSession, path: str) -> DataFrame:
    """A1: CSV files with a header line, every column a string, plus the source file name.

    Columns are matched by name, not by place; a column that a file lacks is null there. Header
    cells are stripped (fix of Q13). Cells that mean missing (``NA``, ``NULL``, ...) read as null.
    """
    return _together(csv_groups(spark, path), path)


def check_kind(path: str) -> None:
    """A3: raise for a file that isn't readable in this build; a folder passes."""
    sfx = suffix_of(path)
    if sfx and sfx not in SUPPORTED:
        raise ValidationError(f"cannot read files of kind {sfx}")
    if sfx == ".xls":
        raise ValidationError("the binary .xls format is not readable; save the file as .xlsx or .csv")


def read_rosters(spark: SparkSession, path: str) -> DataFrame:
    """A1-A3: read a roster file, CSV or workbook, or a folder of them; cells read alike from both."""
    check_kind(path)
    return _together(roster_groups(spark, path), path)


def profile(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """A4: per file, its row count and its header list (one aggregate pass)."""
    headers = [c for c in df.columns if c != file_col]
    return (df.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("headers", F.array(*[F.lit(h) for h in headers])))


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """A4 over a path: (source_file, n_rows, headers), each file with its own headers."""
    return reduce(DataFrame.unionByName, [profile(df.select(*headers, "source_file")) for headers, df in roster_groups(spark, path)])


def _digests(batches):
    """(path, size, line) in order of path and place -> (path, size, digest); the last line may lack its end."""
    path, size, seen, digest = None, 0, 0, None
    out = []
    for batch in batches:
        for now, total, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if now != path:
                if path is not None:
                    out.append((path, size, digest.hexdigest()))
                path, size, seen, digest = now, total, 0, hashlib.sha256()
            part = line.as_buffer()
            digest.update(part)
            seen += len(part) + 1
            if seen <= size:
                digest.update(b"\n")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["path", "length", "file_hash"])
            out = []
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, size, digest.hexdigest())], ["path", "length", "file_hash"])


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of the files of a path, empty ones too: names alone."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while found.hasNext():
        f = found.next()
        if not any(x.startswith(("_", ".")) and "=" not in x for x in f.getPath().toUri().getPath()[len(p.toUri().getPath()):].split("/") if x):
            out.append((f.getPath().toString(), f.getLen()))
    return out


def fingerprint(spark: SparkSession, path: str, whole: int | None = None) -> DataFrame:
    """A5: SHA-256 of each file's bytes, one row per file: (path, length, file_hash).

    The driver lists names only. Files up to ``WHOLE_BYTES`` are hashed as one binaryFile row each; a larger one
    doesn't fit a row: its lines, as bytes, are sorted into one stream, which Spark may spill, so that a task's memory doesn't grow with the file.
    """
    whole = min(WHOLE_BYTES if whole is None else whole, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    listed = _listed(spark, path)
    b = spark.read.format("binaryFile").load(path).where(F.col("length").between(1, whole))
    prints = b.select("path", "length", F.sha2(F.col("content"), 256).alias("file_hash"))
    empty = [(p, 0, hashlib.sha256(b"").hexdigest()) for p, n in listed if not n]
    if empty:
        prints = prints.unionByName(spark.createDataFrame(empty, "path string, length long, file_hash string"))
    large = [p for p, n in listed if n > whole]
    if large:
        lines = spark.read.option("lineSep", "\n").text(large)
        placed = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"),
                              F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        streams = placed.repartition("path").sortWithinPartitions("path", "block", "at").select("path", "size", "line")
        prints = prints.unionByName(streams.mapInArrow(_digests, "path string, length long, file_hash string"))
    return prints


def flag_reimports(prints: DataFrame, ledger: DataFrame) -> DataFrame:
    """A5: informational re-upload flag -- the file's hash is already in the import ledger."""
    seen = ledger.select(F.col("file_hash").alias("_h")).distinct()
    return (prints.join(seen, prints["file_hash"] == seen["_h"], "left")
            .withColumn("is_reimport", F.col("_h").isNotNull()).drop("_h"))


def headers_long(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """(file, pos, header) rows for header mapping, one per column of every file."""
    hs = [c for c in df.columns if c != file_col]
    files = df.select(F.col(file_col).alias("file")).distinct()
    arr = F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(h).alias("header")) for i, h in enumerate(hs)])
    return files.select("file", F.inline(arr)).withColumn("header", strip(F.col("header")))
