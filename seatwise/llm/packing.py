"""Best-fit packing by length patterns and non-negative least squares.

Documents become pieces of 1 to ``size`` tokens, so the whole corpus is a histogram of at most
``size`` lengths, whatever its rows. On the driver, patterns of two and three lengths that fill a
sequence are enumerated, repeat counts are fitted to the histogram by non-negative least squares
and rounded down, and the residual is packed by best fit, longest first, on counts. The plan is a
table of slots per length; the pieces themselves are ranked within their length in parallel (a
position within the writing task plus the counts of the tasks before) and take the slot of their
rank.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.memory import frugal, small_batches
from seatwise.llm.words import blocks
from seatwise.session import drop_scratch, materialise

#: Characters on which both tokenizer libraries read the same classes; other texts go to `tokenizers` itself.
_UNUSUAL = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-ɏ‐-‧€]")


class ByteBpe:
    """Ids as `tokenizers` gives them; usual texts go through the same vocabulary's faster reader."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        import base64

        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _UNUSUAL.search(text) or any(t in text for t in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _pieces(path: str, ranks_path: str | None, pattern: str | None, end_id: int, size: int):
    """(doc_id, text) -> pieces with their place among the pieces of that length of this task."""
    def run(batches):
        coder = ByteBpe(path, ranks_path, pattern)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            few = (batch.slice(lo, hi - lo) for lo, hi, _, _ in blocks(batch.column(1)))  # few texts at a time are Python objects
            for key, text in (r for b in few for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                ids = np.array([*coder.ids(text or ""), end_id], "<u4")
                start, piece = 0, 0
                while start < len(ids):
                    stop = min(len(ids), start + ((len(ids) - start - 1) % size + 1 if piece == 0 else size))
                    rows.append((key, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), seen[stop - start]))
                    seen[stop - start] += 1
                    start, piece = stop, piece + 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)] + [pa.array([part] * len(rows), pa.int32())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])
    return run


def nnls(a: np.ndarray, h: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """x >= 0 that brings a @ x close to h in least squares, by coordinate descent."""
    gram, x = a.T @ a, np.zeros(a.shape[1])
    slope = -(a.T @ h)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(x)):
            new = max(0.0, x[j] - slope[j] / gram[j, j])
            if new != x[j]:
                slope += gram[:, j] * (new - x[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.5:
            break
    return x


def patterns(counts: dict[int, int], size: int, most: int) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill a sequence exactly, the ``most`` with the commonest rarest length."""
    have = sorted(x for x in counts if x < size)
    found = []
    for i, x in enumerate(have):
        if size - x in counts and x <= size - x:
            found.append((x, size - x))
        for y in have[i:]:
            z = size - x - y
            if z < y:
                break
            if z in counts:
                found.append((x, y, z))
    return sorted(found, key=lambda p: (-min(counts[v] // p.count(v) for v in p), p))[:most]


def plan(counts: dict[int, int], size: int, most: int = 1500) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): all pieces of the histogram, none twice."""
    left = {k: int(v) for k, v in counts.items() if v > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(size):
        out.append(((size,), left.pop(size)))
    tried = patterns(left, size, most)
    if tried:
        lengths = sorted(left)
        row = {x: k for k, x in enumerate(lengths)}
        a = np.zeros((len(lengths), len(tried)))
        for j, p in enumerate(tried):
            for v in p:
                a[row[v], j] += 1
        x = nnls(a, np.array([left[v] for v in lengths], float))
        for j in np.argsort(-x, kind="stable").tolist():
            p = tried[j]
            times = min(int(x[j]), *(left[v] // p.count(v) for v in p))
            if times > 0:
                out.append((p, times))
                for v in p:
                    left[v] -= times
    # the residual: longest first into the fullest sequence that has room, in whole groups
    room: dict[int, list[list]] = defaultdict(list)
    for v in sorted(left, reverse=True):
        n = left[v]
        while n > 0:
            space = next((r for r in range(v, size) if room.get(r)), None)
            if space is None:
                each = size // v
                group = [(), n // each if n >= each else 1]
                space = size
            else:
                group = room[space].pop()
                each = space // v
            take = min(each, n)
            times = min(group[1], n // take)
            room[space - take * v].append([group[0] + (v,) * take, times])
            if space < size and group[1] > times:
                room[space].append([group[0], group[1] - times])
            n -= take * times
    return out + [(p, times) for groups in room.values() for p, times in groups if times]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each run of slots, by rank."""
    used, runs, base = Counter(), defaultdict(list), 0
    for p, times in planned:
        at = 0
        for v in p:
            runs[v].append((used[v], base, at))
            used[v] += times
            at += v
        base += times
    return {v: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for v, r in runs.items()}


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 2, size: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A text's ids end with ``end_id``; null and empty texts are that id alone. Only texts of more
    than ``size`` ids are cut, from the end, so that their first piece may be shorter. Repeated
    rows and null ids are packed like others; other columns are ignored whatever their names; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark):
        pieces, path = materialise(rows.mapInArrow(
            frugal(_pieces(tokenizer_path, ranks_path, pattern, end_id, size)),
            "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part int"), "pieces")
    tasks, tasks_path = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pieces-counts")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = spark.sparkContext.broadcast(slots(plan(counts, size)))

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length).tolist():
                own = np.flatnonzero(length == v)
                first, base, at = table.value[v]
                k = np.searchsorted(first, rank[own], side="right") - 1
                seq[own], off[own] = base[k] + rank[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = tasks.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    result, _ = materialise(
        pieces.join(shift, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("shift")).alias("rank"))
        .mapInArrow(frugal(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"), "packed")
    for p in (path, tasks_path):
        drop_scratch(spark, p)
    table.destroy()  # the result is written
    return result
