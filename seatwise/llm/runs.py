"""Periodic runs of words, found as branching tandem repeats in an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word extends. Its last 2q words
are a square whose two halves are followed by different words (or by the end of the text): the halves'
suffixes lie in one LCP interval of depth q, in different children of it. So each LCP interval is visited
once, as two bounds in the suffix array and no tree node: of each suffix i in any but its largest child,
the inverse suffix array tells whether i + q or i - q lies in the interval and in another child. Each
square found is rotated to the left as far as its period holds, and squares with the same extent are one run
of the least period among them.

All texts of a block are handled at once: words are numbered by text, so that no two texts share one, and
sorted by prefix doubling that touches suffixes still tied only. The equality classes of each doubling stay, and
give the LCP values and the rotations by descending powers of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.words import blocks, gather, space_words, spans

CHUNK = 1 << 20
SCHEMA = "row struct<doc_id:long>, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def suffixes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and by k the classes of equal prefixes of 2**k letters (with -1 past the end)."""
    n = len(letters)
    sa = np.argsort(letters, kind="stable")
    key = letters[sa]
    rank = np.full(n + 1, -1, np.int32)
    cut = np.ones(n, bool)
    cut[1:] = key[1:] != key[:-1]
    rank[sa] = np.maximum.accumulate(np.where(cut, np.arange(n), 0))
    levels, slots, step = [], np.arange(n), 1
    while True:
        tied = ~cut
        tied[:-1] |= ~cut[1:]
        slots = slots[tied]
        if not len(slots):
            return sa, rank[:-1], levels
        levels.append(rank)
        mine = sa[slots]
        key = rank[mine].astype(np.int64) * (n + 1) + rank[np.minimum(mine + step, n)] + 1
        order = np.argsort(key, kind="stable")
        mine, key = mine[order], key[order]
        sa[slots] = mine
        cut = np.ones(len(key), bool)
        cut[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[mine] = np.maximum.accumulate(np.where(cut, slots, 0))
        step *= 2


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[j] of the suffixes at j - 1 and j of the suffix array; lcp[0] = lcp[n] = 0."""
    lcp = np.zeros(len(sa) + 1, np.int32)
    if levels:
        near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
        a, b = sa[near], sa[near + 1]
        size = np.zeros(len(near), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][a + size] == levels[k][b + size]).astype(np.int32)
            size += same << k
        lcp[near + 1] = size
    return lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(j, lb, rb): each place with lcp[j] > 0 and the bounds of the LCP interval that it divides."""
    at = np.flatnonzero(lcp)
    value = lcp[at]
    zero = np.flatnonzero(lcp == 0)
    top = max(0, int(np.diff(zero).max(initial=1)).bit_length() - 1)
    least = [lcp]  # least[k][j]: the least of the 2**k values up to j
    for k in range(top):
        half, wide = least[-1], least[-1].copy()
        wide[1 << k:] = np.minimum(half[1 << k:], half[:-(1 << k)])
        least.append(wide)
    left, right = at - 1, at + 1
    for k in range(top, -1, -1):
        on = (left >= (1 << k) - 1) & (least[k][np.maximum(left, 0)] >= value)
        left = left - (on << k)
        far = right + (1 << k) - 1
        on = (far < len(lcp)) & (least[k][np.minimum(far, len(lcp) - 1)] >= value)
        right = right + (on << k)
    return at, left, right - 1


def squares(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, period) of the branching tandem repeats, and the classes of equal prefixes."""
    sa, isa, levels = suffixes(letters)
    n, none = len(sa), np.zeros(0, np.int64)
    if not levels:
        return none, none, levels
    lcp = common_prefixes(sa, levels)
    at, lb, rb = intervals(lcp)
    order = np.argsort(lb * (n + 1) + rb, kind="stable")
    at, lb, rb = at[order], lb[order], rb[order]
    opens = np.ones(len(at), bool)
    opens[1:] = (lb[1:] != lb[:-1]) | (rb[1:] != rb[:-1])
    of = np.cumsum(opens) - 1
    lead = np.flatnonzero(opens)
    m = len(at) + len(lead)  # children: one more than dividing places
    start, end, owner = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m, np.int64)
    begin = lead + np.arange(len(lead))
    after = np.arange(len(at)) + of + 1
    start[begin], start[after] = lb[lead], at
    end[after - 1], end[np.append(begin[1:], m) - 1] = at, rb[lead] + 1
    owner[begin], owner[after] = np.arange(len(lead)), of
    size = end - start
    largest = np.flatnonzero(size == np.maximum.reduceat(size, begin)[owner])
    largest = largest[np.append(True, owner[largest][1:] != owner[largest][:-1])]
    small = np.ones(m, bool)
    small[largest] = False
    small = np.flatnonzero(small)
    depth, low, high = lcp[at[lead]].astype(np.int64), lb[lead], rb[lead]
    found = [(none, none)]
    total = np.cumsum(size[small])
    lo = 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, side="right")))
        child = np.repeat(small[lo:hi], size[small[lo:hi]])
        ahead = np.cumsum(size[small[lo:hi]]) - size[small[lo:hi]]
        i = sa[start[child] + np.arange(len(child)) - np.repeat(ahead, size[small[lo:hi]])]
        d, x, y = depth[owner[child]], low[owner[child]], high[owner[child]]
        for other, begins in ((i + d, i), (i - d, i - d)):
            inside = (other >= 0) & (other < n)
            there = isa[np.clip(other, 0, n - 1)]
            hit = inside & (there >= x) & (there <= y) & ((there < start[child]) | (there >= end[child]))
            found.append((begins[hit], d[hit]))
        lo = hi
    return np.concatenate([p for p, _ in found]), np.concatenate([d for _, d in found]), levels


def runs_of(letters: np.ndarray, least_words: int, least_repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs, by start and then period; letters of two texts differ."""
    start, period, levels = squares(letters)
    end = start + 2 * period
    for k in range(len(levels) - 1, -1, -1):
        back = start - (1 << k)
        on = (back >= 0) & (levels[k][np.maximum(back, 0)] == levels[k][np.maximum(back, 0) + period])
        start = np.where(on, back, start)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    keep = np.flatnonzero(first & (end - start >= np.maximum(least_words, least_repeats * period)))
    keep = keep[np.lexsort((period[keep], start[keep]))]
    return start[keep], end[keep], period[keep]


def _scan(least_words: int, least_repeats: int, block: int):
    inside = space_words()

    def of_block(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        begin, finish, first = spans(data, offsets, inside)
        texts = len(offsets) - 1
        owner = np.repeat(np.arange(texts), np.diff(first))
        words = gather(data, begin, finish).dictionary_encode()
        start, end, period = runs_of(owner * max(1, len(words.dictionary)) + words.indices.to_numpy(), least_words, least_repeats)
        gone = np.cumsum(np.bincount(start + period, minlength=len(begin) + 1) - np.bincount(end, minlength=len(begin) + 1))[:-1] > 0
        kept = np.flatnonzero(~gone)
        by_text = np.searchsorted(owner[start], np.arange(texts + 1)).astype(np.int32)
        base = first[owner[start]]
        runs = pa.ListArray.from_arrays(pa.array(by_text), pa.StructArray.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (start - base, end - start, period)], ["start", "length", "period"]))
        parts = gather(data, begin[kept], finish[kept]).cast(pa.string())
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[kept], np.arange(texts + 1)).astype(np.int32)), parts), " ")
        return [pa.array(np.diff(first).astype(np.int64)), runs, collapsed]

    def scan(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1), block):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *of_block(data, offsets)], ["row", "n_words", "runs", "collapsed"])

    return scan


def periodic_runs(docs: DataFrame, least_words: int = 6, least_repeats: int = 4, block: int = 1 << 20) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` are those of at least ``least_words`` words and
    ``least_repeats`` (two or more) periods, by start, then period; ``collapsed`` joins the words that no run holds after its first period
    by one space. Null and empty texts have no words, no runs and an empty ``collapsed``; rows with a null or repeated
    doc_id are kept, each by itself; other columns are ignored, and empty tables stay empty.
    """
    if least_repeats < 2:
        raise ValueError("a run has at least two periods")
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(least_words, least_repeats, block), SCHEMA).select("row.doc_id", "n_words", "runs", "collapsed")
