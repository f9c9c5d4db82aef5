"""Source divergence audit: how far each source's use of words is from the other sources of its language.

Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased. A language keeps the
terms that at least ``least_docs`` of its rows hold (V of them). A group (lang, source), and a language,
gives each kept term p = 1 + floor(10**9 * (count + 1) / (N + V)), where N sums the counts of the kept
terms; f(p, q) = floor((p - q)**2 / q). A pair of sources of one language has the sum of f over all kept
terms; a term that a group uses more than its language does has its own f.

The pair sums don't visit terms. The terms of a language are laid out in blocks of 64 by falling
frequency, and each (group, count) holds its terms of a block as the bits of one long. Two groups' joint
cell of counts (c, d) is the popcount of the AND of their longs, times f(p(c), q(d)); cells where a count
is zero are never stored: with sizes s(c) of the levels, the sum over all cells is

  sum over c, d > 0 of n(c, d) * (f(c, d) - f(c, 0) - f(0, d) + f(0, 0))
  + sum over c > 0 of s(c) * (f(c, 0) - f(0, 0)) + sum over d > 0 of s(d) * (f(0, d) - f(0, 0)) + V * f(0, 0).

Blocks that two groups don't share cost nothing. Languages with many sources deal the groups into tiles of about
``TILE`` sources, so that one key of the join holds two tiles of one block. Sums are decimals of 38 digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.words import LOWER, blocks, gather, plain_words, spans
from seatwise.session import drop_scratch, materialise

TILE = 64
BLOCK = 4 << 20
BROADCAST_BYTES = 8 << 20
_COUNTED = "lang string, source string, term string, n long, docs long"
_BITS = "lang string, block long, source string, n long, bits long"
BILLION = 1_000_000_000


def _count(batches):
    """(lang, source, term, occurrences, rows that hold it) of each block of texts."""
    inside = plain_words()
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
        for lo, hi, data, offsets in blocks(batch.column(2), BLOCK):
            start, end, first = spans(data, offsets, inside)
            if not len(start):
                continue
            terms = gather(LOWER[data], start, end).dictionary_encode()
            k = len(terms.dictionary)
            held, n = np.unique(np.repeat(np.arange(hi - lo), np.diff(first)) * k + terms.indices.to_numpy(), return_counts=True)
            cell, where = np.unique(group[lo:hi][held // k] * k + held % k, return_inverse=True)
            of, term = cell // k, cell % k
            yield pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(of // max(1, len(source.dictionary)))), source.dictionary.take(pa.array(of % max(1, len(source.dictionary)))),
                terms.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(np.bincount(where, n).astype(np.int64)), pa.array(np.bincount(where))],
                ["lang", "source", "term", "n", "docs"])


def cells(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, total, lead) of the kept terms: ``total`` is the language's count, ``lead`` is 1 in one row of a term."""
    counted = docs.mapInArrow(_count, _COUNTED).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    return (counted.withColumns({"total": F.sum("n").over(same), "held": F.sum("docs").over(same), "lead": (F.row_number().over(same.orderBy("source")) == 1).cast("long")})
            .where(F.col("held") >= least_docs).select("lang", "source", "term", "n", "total", "lead"))


def _lay_out(batches):
    """Bitsets of the cells of a partition sorted by (lang, total, term); a level cut by a batch has several rows."""
    last, at, block, first = None, -1, -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part, lang, total, term = (batch.column(k) for k in range(4))
        mine = [x.dictionary_encode().indices.to_numpy() for x in (lang, term)] + [total.to_numpy()]
        fresh = np.ones(batch.num_rows, bool)
        fresh[1:] = (mine[0][1:] != mine[0][:-1]) | (mine[1][1:] != mine[1][:-1]) | (mine[2][1:] != mine[2][:-1])
        other = np.ones(batch.num_rows, bool)
        other[1:] = mine[0][1:] != mine[0][:-1]
        head = (lang[0].as_py(), total[0].as_py(), term[0].as_py())
        if last is not None:
            fresh[0] = head != last
            other[0] = head[0] != last[0]
        nth = at + np.cumsum(fresh)  # number of the term in this partition
        begin = np.maximum.accumulate(np.where(other, nth, -1))  # number of its language's first term
        begin = np.where(begin < 0, first, begin)
        opens = fresh & ((nth - begin) % 64 == 0)
        number = block + np.cumsum(opens)
        last, at, block, first = (lang[-1].as_py(), total[-1].as_py(), term[-1].as_py()), int(nth[-1]), int(number[-1]), int(begin[-1])
        source = batch.column(4).dictionary_encode()
        level = source.indices.to_numpy().astype(np.int64)
        n = batch.column(5).to_numpy()
        order = np.lexsort((n, level, number))
        cut = np.ones(len(order), bool)
        cut[1:] = (np.diff(number[order]) != 0) | (np.diff(level[order]) != 0) | (np.diff(n[order]) != 0)
        lead = order[np.flatnonzero(cut)]
        bit = np.left_shift(np.uint64(1), ((nth - begin) % 64).astype(np.uint64))
        bits = np.bitwise_or.reduceat(bit[order], np.flatnonzero(cut)).view(np.int64)
        yield pa.RecordBatch.from_arrays([lang.take(pa.array(lead)), pa.array((part[0].as_py() << 33) + number[lead]), batch.column(4).take(pa.array(lead)),
                                          pa.array(n[lead]), pa.array(bits)], ["lang", "block", "source", "n", "bits"])


def bitsets(kept: DataFrame) -> DataFrame:
    """(lang, block, source, n, bits): the terms of a block that occur n times in a group."""
    order = ("lang", F.col("total").desc(), "term")
    laid = kept.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "lang", "total", "term", "source", "n")
    return laid.mapInArrow(_lay_out, _BITS).groupBy("lang", "block", "source", "n").agg(F.bit_or("bits").alias("bits"))


def share(count: Column, size: Column) -> Column:
    """p of a count, with ``size`` = N + V."""
    whole = F.lit(BILLION).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", whole, F.greatest(size, F.lit(1)).cast("decimal(19,0)"))


def f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _dealt(left: DataFrame, right: DataFrame, tiles: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with keys (ti, tj): a pair of a left and a right row shares exactly one."""
    own, every = F.pmod(F.xxhash64("source"), F.lit(tiles)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    return left.withColumn("ti", own).withColumn("tj", every), right.withColumn("tj", own).withColumn("ti", every)


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], when: Column, there: Column, back: Column) -> DataFrame:
    """Sums by ordered pair of ``there`` (for left, right) and ``back`` (for right, left) over the joined rows."""
    joined = left.alias("a").join(right.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [when])
    by_pair = joined.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("x"), F.col("b.source").alias("y")).agg(
        F.sum(there.cast("decimal(28,0)")).alias("there"), F.sum(back.cast("decimal(28,0)")).alias("back"))
    both = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item"), F.col("there").alias("value")),
                             F.struct(F.col("y").alias("source"), F.col("x").alias("item"), F.col("back").alias("value"))))
    return by_pair.select("lang", both.alias("_")).select("lang", "_.*")


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of ``docs`` (lang, source, text).

    Part ``pair`` has all other sources of the language, part ``term`` the ``top`` kept terms that the group
    uses more than its language does; rank counts from 1 by falling value, then by item. Null text, lang and
    source read as ''; a group without kept terms has pairs and no terms; a language without kept terms has value 0; every
    row counts as a document, repeated ids too; an empty table has no rows; other columns are ignored.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    scratch = []

    def keep(df, name):
        out, path = materialise(df, f"divergence-{name}")
        scratch.append(path)
        return out

    kept = keep(cells(read, least_docs), "cells")
    langs = read.select("lang").distinct().join(kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("lead").alias("v")), "lang", "left").fillna(0)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n_all"]).join(langs, "lang")
    groups = groups.select("lang", "source", "v", (F.col("n_all") + F.col("v")).alias("size"), (F.col("n_lang") + F.col("v")).alias("lang_size"))
    groups = keep(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("size"))), "groups")
    width = groups.agg(F.sum(F.length("lang") + F.length("source") + 64)).first()[0] or 0
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    tiles = -(-most // tile)
    small = F.broadcast(groups) if width <= BROADCAST_BYTES else groups  # measured; beyond that a shuffle join

    bits = bitsets(kept).join(small, ["lang", "source"]).select("lang", "block", "source", share(F.col("n"), F.col("size")).alias("p"), "p0", "bits")
    bits = keep(bits, "bits")
    left, right = _dealt(bits, bits, tiles)
    ap, a0, bp, b0 = (F.col(c) for c in ("a.p", "a.p0", "b.p", "b.p0"))
    cell = F.bit_count(F.col("a.bits").bitwiseAND(F.col("b.bits"))).cast("long")
    meet = (F.col("a.source") < F.col("b.source")) & (F.col("a.bits").bitwiseAND(F.col("b.bits")) != 0)
    joint = _pairs(left, right, ["lang", "block", "ti", "tj"], meet, cell * (f(ap, bp) - f(ap, b0) - f(a0, bp) + f(a0, b0)),
                   cell * (f(bp, ap) - f(b0, ap) - f(bp, a0) + f(b0, a0)))

    levels = kept.groupBy("lang", "source", "n").count().join(small, ["lang", "source"]).select(
        "lang", "source", share(F.col("n"), F.col("size")).alias("p"), "p0", F.col("count").alias("s"))
    apart = F.col("a.source") != F.col("b.source")
    left, right = _dealt(levels, groups, tiles)
    if width * tiles <= BROADCAST_BYTES:
        right = F.broadcast(right)
    edges = _pairs(left, right, ["lang", "ti", "tj"], apart, F.col("a.s") * (f(ap, b0) - f(a0, b0)), F.col("a.s") * (f(b0, ap) - f(b0, a0)))

    left, right = _dealt(groups, groups, tiles)
    if width * tiles <= BROADCAST_BYTES:
        right = F.broadcast(right)
    ground = left.alias("a").join(right.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("lang", "ti", "tj")] + [apart]).select(
        F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), (F.col("a.v") * f(a0, b0)).cast("decimal(38,0)").alias("value"))
    pair = ground.unionByName(joint).unionByName(edges).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    p, q = share(F.col("n"), F.col("size")), share(F.col("total"), F.col("lang_size"))
    term = (kept.join(small, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
            .select("lang", "source", "item", f(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
    out = pair.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair")).unionByName(term.withColumn("part", F.lit("term")))
    result, _ = materialise(out.select("lang", "source", "part", "item", "value", "rank"), "divergence")
    for path in scratch:
        drop_scratch(docs.sparkSession, path)
    return result
