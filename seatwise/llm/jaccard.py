"""N-gram Jaccard join by PartEnum signatures.

Two sets of sizes s <= r with Jaccard >= t differ in at most (1 - t) / (1 + t) * (s + r) elements.
Sizes are cut into bands [l, l / t]; a partner lies in the same band or in a neighbour, so a set
takes part in two instances, that of its band and that of the next. Instance i hashes the element
domain into n = k + 1 + spare partitions, k being the largest difference its sets can have: at
least n - k partitions of a linked pair then hold exactly the same elements. A signature is the
hash of a set's elements in one partition (the enumerated subsets are the single partitions), so
every linked pair shares a signature. The spare partitions let sets leave out their empty
partitions, which would be shared by all; a set with so many empty ones that the argument fails
emits them too. Nothing is approximate but 64-bit hashing.

Signatures are dealt by their hash and sorted in blocks; those held by one set only go. In the
group of each remaining signature the set most of whose signatures are shared is the lead, and
each set is compared with its leads: near copies contract to components at one comparison a
member. A linked pair shares a signature, so both lie in the family of one lead; within families
that still hold several components the sets of different components are compared in block pairs.
Comparisons run first on parity sketches: each set has a bitmap in which every element flips one
bit, so the number of bits in which two bitmaps differ never exceeds the number of elements in
which the sets differ, and a pair over the bound is ruled out for certain. The rest is decided on
the sets themselves.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm import words as W
from seatwise.llm.memory import frugal, small_batches
from seatwise.llm.components import connected_components
from seatwise.session import drop_scratch, materialise, scratch_path

_MULTIPLIERS = np.array([0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, and where each text's begin.

    A text with fewer words than ``width`` has its whole word sequence as its only shingle; one
    without words has none.
    """
    found = W.Words(data, offsets, W.space_words())
    h, first = found.hashes(), found.first
    n, counts = len(h), np.diff(first)
    every = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        every = every * _MULTIPLIERS[0] + W.mix(h[j:j + len(every)], 11 + j)
    every = W.mix(every, 3)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begin[-1], np.uint64)
    keep = np.zeros(begin[-1], bool)
    for d, (at, size, lo) in enumerate(zip(begin[:-1].tolist(), sizes.tolist(), first[:-1].tolist(), strict=True)):
        if not size:
            continue
        own = out[at:at + size]
        if counts[d] >= width:
            own[:] = every[lo:lo + size]
            own.sort()
        else:
            own[0] = functools.reduce(lambda x, y: (x * int(_MULTIPLIERS[1]) + y) & W._MASK, map(int, h[lo:lo + counts[d]]), int(counts[d]))
        keep[at] = True
        np.not_equal(own[1:], own[:-1], out=keep[at + 1:at + size])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[begin]


class Bands:
    """Size bands of a threshold of ``percent`` / 100 and the instance parameters."""

    def __init__(self, percent: int):
        self.percent, self.low, self.parts, self.spare = percent, [1], [], []

    def _fill(self, band: int) -> None:
        while len(self.parts) <= band:
            low = self.low[len(self.parts)]
            high = low * 100 // self.percent
            self.low.append(high + 1)
            k = (100 - self.percent) * 2 * high // (100 + self.percent)
            n = 1 if k == 0 else k + 2 + k // 32
            self.parts.append(n)
            self.spare.append(n - k)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while self.low[-1] <= (sizes.max() if len(sizes) else 0):
            self._fill(len(self.parts))
        return np.searchsorted(self.low, sizes, side="right") - 1

    def instance(self, i: int) -> tuple[int, int]:
        self._fill(i)
        return self.parts[i], self.spare[i]


def signatures(elements: np.ndarray, begin: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all sets, by instance."""
    sizes = np.diff(begin)
    band = bands.of(sizes)
    weight = W.mix(elements, 21)
    sigs, owners = [], []
    for i in np.unique(np.concatenate([band[sizes > 0], band[sizes > 0] + 1])).tolist():
        n, spare = bands.instance(i)
        mine = np.flatnonzero((sizes > 0) & ((band == i) | (band == i - 1)))
        lengths = sizes[mine]
        local = np.repeat(np.arange(len(mine)), lengths)
        shift = np.cumsum(lengths) - lengths
        at = np.arange(len(local)) + np.repeat(begin[mine] - shift, lengths)
        cell = local * n + (W.mix(elements[at], 100 + i) % np.uint64(n)).astype(np.int64)
        total = np.zeros(len(mine) * n, np.uint64)
        np.add.at(total, cell, weight[at])
        empty = (np.bincount(cell, minlength=len(total)) == 0).reshape(len(mine), n)
        emit = ~empty | (empty.sum(1) >= spare)[:, None]
        row, part = np.nonzero(emit)
        sigs.append(W.mix(total.reshape(len(mine), n)[row, part] ^ W.mix(part.astype(np.uint64) + np.uint64(n * i), 31), 200 + i))
        owners.append(mine[row])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def sketch_bytes(sizes: np.ndarray) -> np.ndarray:
    """Bytes of the parity sketch of a set of each size: a power of two, at least 1.3 bits an element."""
    return 1 << np.maximum(3, np.ceil(np.log2(np.maximum(1, sizes) * 1.3 / 8)).astype(np.int64))


def sketches(elements: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of all sets in one byte array, and where each begins."""
    sizes = np.diff(begin)
    length = sketch_bytes(sizes)
    at = np.concatenate([[0], np.cumsum(length)])
    bit = (W.mix(elements, 51) % np.repeat(length * 8, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(at[:-1] * 8, sizes)
    return np.packbits((np.bincount(bit, minlength=at[-1] * 8) & 1).astype(np.uint8), bitorder="little"), at


_DEALT = "bucket int, ids binary, sids binary, sizes binary, counts binary, sigs binary"
_SIG = 5  # bytes kept of a signature besides its bucket; more collisions would only mean more comparisons


def _deal(width: int, percent: int, buckets: int):
    """Arrow batches of (doc_id, text) -> blobs by bucket; a bucket below 0 carries documents."""
    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in W.blocks(batch.column(1)):
                elements, begin = shingle_sets(data, offsets, width)
                sizes = np.diff(begin)
                sid = set_ids(elements, begin)
                flips, _ = sketches(elements, begin)
                rows = [(-1 - int(ids[lo]) % buckets, ids[lo:hi].tobytes(), sid.tobytes(), sizes.astype(np.int32).tobytes(), b"", flips.tobytes())]
                _, lead = np.unique(sid, return_index=True)  # copies inside the block go once
                chosen = np.sort(lead)
                chosen = chosen[sizes[chosen] > 0]
                part = np.concatenate([elements[begin[d]:begin[d + 1]] for d in chosen]) if len(chosen) else elements[:0]
                sig, own = signatures(part, np.concatenate([[0], np.cumsum(sizes[chosen])]).astype(np.int64), bands)
                own = chosen[own] if len(own) else own
                bucket = (sig >> np.uint64(40)) % np.uint64(buckets)
                order = np.lexsort((own, bucket))
                sig, own, bucket = sig[order], own[order], bucket[order]
                short = np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SIG])
                cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    sets, counts = np.unique(own[cut[b]:cut[b + 1]], return_counts=True)
                    rows.append((b, b"", sid[sets].tobytes(), sizes[sets].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), short[cut[b]:cut[b + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 6)],
                    ["bucket", "ids", "sids", "sizes", "counts", "sigs"])
    return run


class _Shared:
    """Entries of one bucket as they come; gives those whose signature has several sets.

    Only entries of signatures seen with one set are held; when they grow past ``hold`` those
    that have become shared are given out, and their signature is remembered as shared.
    """

    SLICES = 8

    def __init__(self, hold: int = 1 << 22):
        self.hold, self.parts, self.count = hold, [], 0
        self.known = np.zeros(0, np.uint64)

    def add(self, sig, sid, size):
        if len(self.known):
            old = self.known[np.minimum(np.searchsorted(self.known, sig), len(self.known) - 1)] == sig
            if old.any():
                yield sig[old], sid[old], size[old]
                sig, sid, size = sig[~old], sid[~old], size[~old]
        self.parts.append((sig, sid, size))
        self.count += len(sig)
        if self.count > self.hold:
            yield from self.settle()
            self.hold = max(self.hold, 2 * self.count)

    def settle(self):
        if not self.parts:
            return
        every = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.count = [], 0
        share = every[0] % np.uint64(self.SLICES)  # sorted a share of the signatures at a time
        for k in range(self.SLICES):
            sig, sid, size = (x[share == k] for x in every)
            order = np.lexsort((sid, sig))
            sig, sid, size = sig[order], sid[order], size[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
            sig, sid, size = sig[new], sid[new], size[new]
            same = np.zeros(len(sig) + 1, bool)
            same[1:-1] = sig[1:] == sig[:-1]
            many = same[1:] | same[:-1]
            if many.any():
                self.known = np.union1d(self.known, sig[many])
                yield sig[many], sid[many], size[many]
            self.parts.append((sig[~many], sid[~many], size[~many]))
            self.count += len(self.parts[-1][0])


_GATHERED = "kind string, doc_id long, sig long, sid long, size int, sketch binary"


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _gather(batches):
    """Blobs sorted by bucket -> documents (kind d) and entries of shared signatures (kind g)."""
    def shared(found):
        for sig, sid, size in found:
            n = len(sid)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["g"] * n, pa.string()), pa.nulls(n, pa.int64()), pa.array(sig.view(np.int64)), pa.array(sid), pa.array(size), pa.nulls(n, pa.binary())],
                ["kind", "doc_id", "sig", "sid", "size", "sketch"])

    at, state = None, _Shared()
    for batch in batches:
        for bucket, ids, sids, sizes, counts, sigs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sid, size = np.frombuffer(sids, np.int64), np.frombuffer(sizes, np.int32)
            n = len(sid)
            if bucket < 0:
                where = np.concatenate([[0], np.cumsum(sketch_bytes(size))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["d"] * n, pa.string()), pa.array(np.frombuffer(ids, np.int64)), pa.nulls(n, pa.int64()), pa.array(sid), pa.array(size),
                     _binary(np.frombuffer(sigs, np.uint8), where)], ["kind", "doc_id", "sig", "sid", "size", "sketch"])
                continue
            if bucket != at:
                yield from shared(state.settle())
                at, state = bucket, _Shared()
            times = np.frombuffer(counts, np.int32)
            wide = np.zeros((int(times.sum()), 8), np.uint8)
            wide[:, :_SIG] = np.frombuffer(sigs, np.uint8).reshape(-1, _SIG)
            sig = wide.view("<u8").ravel() | np.uint64(bucket << 8 * _SIG)
            yield from shared(state.add(sig, np.repeat(sid, times), np.repeat(size, times)))
    yield from shared(state.settle())


def set_ids(elements: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set."""
    sizes = np.diff(begin)
    total = np.zeros(len(sizes), np.uint64)
    np.add.at(total, np.repeat(np.arange(len(sizes)), sizes), W.mix(elements, 41))
    return W.mix(total + sizes.astype(np.uint64), 42).view(np.int64)


def _sets(width: int):
    """(sid, text) -> (sid, sorted shingle hashes), for texts that have that set (an id may stand for several texts)."""
    def run(batches):
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            for lo, hi, data, offsets in W.blocks(batch.column(1)):
                elements, begin = shingle_sets(data, offsets, width)
                own = np.flatnonzero(set_ids(elements, begin) == wanted[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted[lo:hi][own]), pa.array([elements[begin[d]:begin[d + 1]].tobytes() for d in own], pa.binary())], ["sid", "elements"])
    return run


def _fold(sketch: bytes, length: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > length:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def _bound(p, q, percent: int):
    """Most elements in which linked sets of these sizes can differ."""
    return (100 - percent) * (p + q) // (100 + percent)


def _may_link(percent: int):
    """Rows (a, b, a_size, b_size, a_sketch, b_sketch) -> (a, b) that the sketches don't rule out."""
    def run(batches):
        for batch in batches:
            a_size, b_size = (batch.column(k).to_numpy() for k in (2, 3))
            most = _bound(a_size.astype(np.int64), b_size, percent)
            keep = [int(np.bitwise_count(_fold(x, n) ^ _fold(y, n)).sum()) <= m
                    for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True) for n in (min(len(x), len(y)),)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if len(p) > len(q):
        p, q = q, p
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _verify(percent: int):
    """Rows (a, b, elements of a, elements of b) -> the linked (a, b)."""
    def run(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                    for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _by_key(batches, keys: int):
    """Columns after the first ``keys`` of each run of equal keys, over batch borders."""
    key, parts = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ks = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cuts = [0, *(np.flatnonzero(functools.reduce(np.logical_or, [k[1:] != k[:-1] for k in ks])) + 1).tolist(), n]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(int(k[lo]) for k in ks)
            if now != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = now
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield key, pa.Table.from_batches(parts)


_BLOCK_KEY = "lead long, i int, j int"


def _open_blocks(percent: int):
    """Rows (lead, i, j, block, sid, size, label, sketch) sorted by block pair -> members with a partner of another label that sketches don't rule out."""
    def run(batches):
        for (lead, i, j), t in _by_key(batches, 3):
            block, sid, size, label = (t.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5, 6))
            raw = t.column(7).to_pylist()
            length = min(map(len, raw))
            sk = np.stack([_fold(x, length) for x in raw]).view(np.uint64)
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            mark = np.zeros(len(sid), bool)
            for x in left.tolist():
                other = right[label[right] != label[x]]
                if len(other):
                    apart = np.bitwise_count(sk[other] ^ sk[x]).sum(1, dtype=np.int64)
                    hit = other[apart <= _bound(size[x], size[other], percent)]
                    mark[hit] = True
                    mark[x] |= bool(len(hit))
            if mark.any():
                n = int(mark.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lead] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(block[mark].astype(np.int32)),
                     pa.array(sid[mark]), pa.array(label[mark])], ["lead", "i", "j", "block", "sid", "label"])
    return run


def _close_blocks(percent: int):
    """Rows (lead, i, j, block, sid, label, elements) sorted by block pair -> links between components, enough to connect all that the block pair connects."""
    def run(batches):
        for (_, i, j), t in _by_key(batches, 3):
            block, sid, label = (t.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in t.column(6).chunks for x in c]
            parent = {x: x for x in label.tolist()}

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            a, b = [], []
            right = np.flatnonzero(block == j).tolist()
            for x in np.flatnonzero(block == i).tolist():
                for y in right:
                    if (r := root(int(label[x]))) != (s := root(int(label[y]))) and linked(sets[x], sets[y], percent):
                        parent[r] = s
                        a.append(int(sid[x]))
                        b.append(int(sid[y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _families(entries: DataFrame, degree: DataFrame) -> DataFrame:
    """(lead, sid): of each signature's sets the one of the highest degree, then smallest sid.

    An aggregate and a join, which Spark combines before the shuffle and may split: a signature
    can be that of a third of all rows.
    """
    top = (entries.join(degree, "sid").groupBy("sig")
           .agg(F.max(F.struct("degree", (-F.col("sid")).alias("x"))).alias("top")))
    return entries.join(top, "sig").select((-F.col("top.x")).alias("lead"), "sid").distinct()


def _grouped(rows: DataFrame, keep, scratch: list[str], width: int, percent: int, block: int, broadcast_ids: int) -> DataFrame:
    """The written result of ``jaccard_groups``; ``keep`` writes a table for the time of the run."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "jaccard")
    scratch.append(path)
    (rows.mapInArrow(frugal(_deal(width, percent, buckets)), _DEALT).repartition("bucket").sortWithinPartitions("bucket")
     .mapInArrow(frugal(_gather), _GATHERED).write.partitionBy("kind").parquet(path))
    found = spark.read.schema(_GATHERED).parquet(path)
    members = found.where("kind = 'd'")
    entries = found.where("kind = 'g'").select("sig", "sid", "size")

    # each signature's lead: the set that shares most signatures, which is the hub of near copies
    degree = entries.groupBy("sid").agg(F.count("*").alias("degree"))
    family = keep(_families(entries, degree), "family")
    about = keep(members.join(degree.select("sid"), "sid", "left_semi")
                 .groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "about")

    def side(c):
        return about.select(F.col("sid").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch"))

    near = keep(family.where("lead <> sid").select(F.greatest("lead", "sid").alias("a"), F.least("lead", "sid").alias("b")).distinct()
                .join(side("a"), "a").join(side("b"), "b")
                .select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch").mapInArrow(frugal(_may_link(percent)), "a long, b long"), "near")

    def sets_of(wanted):
        ids = keep(about.join(wanted.distinct(), "sid", "left_semi").select("sid", "doc_id"), "wanted")
        if ids.count() <= broadcast_ids:  # else the texts move to the ids
            ids = F.broadcast(ids)
        return rows.join(ids, "doc_id").select("sid", "text").mapInArrow(frugal(_sets(width)), "sid long, elements binary")

    sets = keep(sets_of(near.select(F.col("a").alias("sid")).unionByName(near.select(F.col("b").alias("sid")))), "sets")
    x, y = (sets.select(F.col("sid").alias(c), F.col("elements").alias(f"{c}_set")) for c in "ab")
    links = keep(near.join(x, "a").join(y, "b").select("a", "b", "a_set", "b_set").mapInArrow(frugal(_verify(percent)), "a long, b long"), "links")
    first = keep(connected_components(links), "labels")

    # families that still hold members, besides the lead, of several components
    labelled = (family.join(first, family["sid"] == first["node"], "left")
                .select("lead", "sid", F.coalesce("component", "sid").alias("label")))
    mixed = (labelled.where("lead <> sid").groupBy("lead")
             .agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
             .where("x <> y").select("lead", "blocks"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    spread = (labelled.where("lead <> sid").join(mixed, "lead").join(about.select("sid", "size", "sketch"), "sid")
              .withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("lead", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "size", "label", "sketch"))
    open_ = keep(spread.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")
                 .mapInArrow(frugal(_open_blocks(percent)), f"{_BLOCK_KEY}, block int, sid long, label long"), "open")
    more = keep(sets_of(open_.select("sid")), "more-sets")
    late = keep(open_.join(more, "sid").select("lead", "i", "j", "block", "sid", "label", "elements")
                .repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")
                .mapInArrow(frugal(_close_blocks(percent)), "a long, b long"), "late")
    labels = keep(connected_components(links.unionByName(late)), "final")

    joined = members.join(labels, members["sid"] == labels["node"], "left").select(
        "doc_id", F.when(F.col("size") > 0, F.coalesce("component", "sid")).alias("c"), F.col("size").cast("long").alias("n_shingles"))
    least = joined.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return materialise(joined.join(least, "c", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")), "jaccard-result")[0]


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85,
                   block: int = 2048, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of documents linked by word-shingle Jaccard.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Null and empty texts, and
    texts of white space, have n_shingles 0 and are alone in their component; texts with fewer than
    ``width`` words have their whole sequence as one shingle; equal sets are linked; other columns
    are ignored whatever their names; rows with a null id are left out; a repeated id gives a row
    each time. An empty table gives an empty result. ``block`` bounds the sets compared in one task; the ids of sets to read again are broadcast up to
    ``broadcast_ids`` rows of two longs, counted first, and joined by a shuffle beyond that.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    scratch = []

    def keep(df, name):
        out, p = materialise(df, f"jaccard-{name}")
        scratch.append(p)
        return out

    with small_batches(spark):
        result = _grouped(rows, keep, scratch, width, percent, block, broadcast_ids)
    for p in scratch:
        drop_scratch(spark, p)
    return result
