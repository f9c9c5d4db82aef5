"""Records of CSV files of any size, by byte range.

The text source cuts files into ranges at line ends; a quoted cell may hold line breaks, so a range may begin inside
a record. Two passes, neither of which moves lines between tasks:

1. each range says in which state it ends if it begins outside or inside quotes. Whether a range
   begins inside follows from the ranges before it by window sums, a row a range;
2. knowing that, each range gives its whole records, the tail of a record that it doesn't end and the
   head of one that it didn't begin. Tails and heads, two rows a range at most, are joined.

Quotes open a cell at its start only and are doubled inside; a quote elsewhere is text. Line ends are ``\\n`` or ``\\r\\n``
(inside a cell they read as ``\\n``); blank lines are no records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.operators.rank import materialise

WHOLE, TAIL, HEAD = 0, 1, 2
BROADCAST_RANGES = 200_000
GLOB = "*.[cC][sS][vV]"


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, given whether one was before."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1:at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
            inside, at = False, at + 1
        elif at == 0 and line[:1] == '"':
            inside, at = True, 1
        else:
            at = line.find(',"', at)
            if at < 0:
                return False
            inside, at = True, at + 2


def _runs(batch: pa.RecordBatch):
    """(first, one past the last, file, block) of each range's lines in a batch with file and block first."""
    if not batch.num_rows:
        return
    file, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
    cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield lo, hi, batch.column(0)[lo].as_py(), int(block[lo])


def _states(batches):
    """(file, block, line or null) -> (file, block, from_out, from_in) of each range; lines without a quote are null."""
    def row(key, state):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *state)], ["file", "block", "from_out", "from_in"])

    key, state = None, (False, True)
    for batch in batches:
        for lo, hi, *now in _runs(batch):
            if now != key:
                if key:
                    yield row(key, state)
                key, state = now, (False, True)
            for line in batch.column(2).slice(lo, hi - lo).drop_null().to_pylist():
                state = inside_after(line, state[0]), inside_after(line, state[1])
    if key:
        yield row(key, state)


class _Cutter:
    """Lines of one range -> its records; ``open`` holds the lines of a record that hasn't ended."""

    def __init__(self, inside: bool):
        self.inside, self.at, self.open, self.first, self.kind = inside, 0, [], 0, HEAD if inside else WHOLE

    def feed(self, block: int, lines: pa.Array):
        """Positions of lines that are whole records, then (line, kind, closes, text) of the others."""
        whole, other, n = [], [], len(lines)
        quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()
        at = 0
        for k in [*quoted, n]:
            if self.inside:
                self.open += lines.slice(at, k - at).to_pylist()
            else:
                whole.append(np.arange(at, k))
            if k == n:
                break
            line, before = lines[k].as_py(), self.inside
            self.inside = inside_after(line, before)
            if not before and not self.inside:
                whole.append(np.arange(k, k + 1))
            else:
                if not before:
                    self.first, self.kind = block + self.at + k, TAIL
                self.open.append(line)
                if not self.inside:
                    other.append((self.first if self.kind == TAIL else block, WHOLE if self.kind == TAIL else HEAD, True, "\n".join(self.open)))
                    self.open, self.kind = [], TAIL
            at = k + 1
        self.at += n
        return np.concatenate(whole) if whole else np.zeros(0, np.int64), other

    def rest(self, block: int):
        """What the range leaves open: a tail, or lines in the middle of a record."""
        if self.inside:
            yield (self.first if self.kind == TAIL else block), self.kind, False, "\n".join(self.open)


def _cut(schema: list[str]):
    def run(batches):
        def batch_of(file, folders, lines, kinds, closes, texts):
            n = len(lines)
            return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(lines, pa.int64()), pa.array(kinds, pa.int32()), pa.array(closes, pa.bool_()),
                                               texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), folders], schema)

        key, cutter, last = None, None, None
        for batch in batches:
            for lo, hi, *now in _runs(batch):
                if now != key:
                    if key:
                        for line, kind, closes, text in cutter.rest(key[1]):
                            yield batch_of(key[0], last, [line], [kind], [closes], [text])
                    key, cutter = now, _Cutter(batch.column(2)[lo].as_py())
                folders, lines, before = batch.column(4), batch.column(3).slice(lo, hi - lo), cutter.at
                last = folders.slice(lo, 1)
                whole, other = cutter.feed(now[1], lines)
                if len(whole):
                    n, take = len(whole), pa.array(whole + lo)
                    yield batch_of(now[0], folders.take(take), now[1] + before + whole, np.zeros(n, np.int32), np.ones(n, bool), batch.column(3).take(take))
                if other:
                    yield batch_of(now[0], folders.take(pa.array([lo] * len(other))), *map(list, zip(*other, strict=True)))
        if key:
            for line, kind, closes, text in cutter.rest(key[1]):
                yield batch_of(key[0], last, [line], [kind], [closes], [text])
    return run


def begins_inside(states: DataFrame) -> DataFrame:
    """(file, block, inside): whether a range begins inside quotes, of (file, block, from_out, from_in).

    A range passes its state on, swaps it, or ends in the same state whatever it began in. The state before
    a range is that of the last range of the third kind, swapped as often as ranges since then do.
    """
    order = Window.partitionBy("file").orderBy("block")
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    s = states.withColumn("swaps", F.sum(swap).over(order) % 2)
    fixed = F.when(F.col("from_out") == F.col("from_in"), (F.col("from_out").cast("int") + F.col("swaps")) % 2)
    s = s.withColumn("fixed", F.last(fixed, ignorenulls=True).over(order))
    after = ((F.coalesce("fixed", F.lit(0)) + F.col("swaps")) % 2) == 1
    return s.withColumn("after", after).select("file", "block", F.coalesce(F.lag("after").over(order), F.lit(False)).alias("inside"))


def csv_records(spark: SparkSession, path: str, folder: bool, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """(file, line, text, folders): every record of the CSV files of a path, header records too.

    ``line`` grows along a file and is not the same for two records of it; ``folders`` is a struct of the columns of partition folders.
    """
    reader = spark.read.option("pathGlobFilter", GLOB).option("lineSep", "\n")
    text = (reader.option("basePath", path) if folder else reader).text(path)
    columns = [F.col(f"`{c}`") for c in text.columns if c != "value"]
    folders = F.struct(*columns) if columns else F.struct(F.lit(None).cast("string").alias("_none"))
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", folders.alias("folders"))
    states = lines.select("file", "block", F.when(F.contains("value", F.lit('"')), F.col("value"))).mapInArrow(
        _states, "file string, block long, from_out boolean, from_in boolean")
    known = materialise(begins_inside(states), "csv-ranges")
    if known.count() <= broadcast_ranges:  # a row a range
        told = lines.join(F.broadcast(known), ["file", "block"])
    else:  # the join moves the lines; their order in the range comes back by a sort
        told = (lines.withColumn("_at", F.monotonically_increasing_id()).join(known, ["file", "block"])
                .repartition("file", "block").sortWithinPartitions("file", "block", "_at"))
    names = ["file", "line", "kind", "closes", "text", "folders"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.StringType()), strict=False)]
                          + [lines.schema["folders"]])
    cut = materialise(told.select("file", "block", "inside", "value", "folders").mapInArrow(_cut(names), schema), "csv-records")
    parts = cut.where(F.col("kind") != WHOLE)  # two a range at most
    own = F.last(F.when(F.col("kind") == TAIL, F.col("line")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line", "kind"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda p: p["text"])
    joined = (parts.withColumn("start", own).groupBy("file", "start")
              .agg(F.array_join(pieces, "\n").alias("text"), F.first("folders").alias("folders")).select("file", F.col("start").alias("line"), "text", "folders"))
    records = cut.where(F.col("kind") == WHOLE).select("file", "line", "text", "folders").unionByName(joined)
    clean = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", "")
    return records.withColumn("text", clean).where(F.trim("text") != "")
