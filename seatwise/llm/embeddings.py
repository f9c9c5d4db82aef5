"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised, so cosine >= t means a Euclidean distance of at most d = sqrt(2 - 2t). A
table hashes a vector to the floors of ``k`` Gaussian projections, shifted and divided by a width;
vectors at distance d agree in one of them with probability p(d / width). From the number of
vectors follow k (so that unrelated vectors rarely meet) and the number of tables (so that a pair
at the threshold meets in some table with probability ``recall``), the same rule at every size.

Members of a bucket are compared exactly, in blocks of bounded size: a bucket of many vectors is
cut into blocks and each pair of blocks is a task group of its own. No pair is emitted: a pair is
counted in the first table in which it meets, counts are summed, and each block pair gives the
edges of a spanning forest of the links found in it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.jaccard import _by_key
from seatwise.llm.components import connected_components
from seatwise.session import drop_scratch, materialise


def agreement(c: float) -> float:
    """Probability that one projection puts two vectors at distance c widths into one cell."""
    if c <= 0:
        return 1.0
    phi = 0.5 * math.erfc(1 / (c * math.sqrt(2)))
    return 1 - 2 * phi - 2 * c / math.sqrt(2 * math.pi) * (1 - math.exp(-1 / (2 * c * c)))


def plan(n: int, cosine: float, width: float, recall: float, unrelated: float = 0.0) -> tuple[int, int]:
    """(projections, tables) for n vectors; about 32 vectors at cosine ``unrelated`` meet by chance."""
    near = agreement(math.sqrt(2 - 2 * cosine) / width)
    far = agreement(math.sqrt(2 - 2 * unrelated) / width)
    k = max(4, math.ceil(math.log(max(n, 2) / 32) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near ** k)))


def unit(x: np.ndarray) -> np.ndarray | None:
    """The vector at length 1 in double precision; None for one that has no direction."""
    x = x.astype(np.float64)
    top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0
    if not top > 0:
        return None
    x = x / top  # so that the norm neither overflows nor vanishes
    return x / np.linalg.norm(x)


def _hash(k: int, tables: int, width: float, seed: int):
    """(vec_id, embedding) -> (vec_id, components as bytes, a 32-bit cell for each table), usable vectors only."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            by_dim: dict[int, list] = {}
            for i, v in enumerate(batch.column(1)):
                raw = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0)
                if (x := unit(raw)) is not None:
                    by_dim.setdefault(len(x), []).append((ids[i], raw, x))
            for dim, rows in by_dim.items():
                rng = np.random.default_rng([seed, dim])
                lines, shift = rng.normal(size=(dim, k * tables)), rng.uniform(0, 1, k * tables)
                mult = rng.integers(1, 2 ** 62, k, dtype=np.int64) * 2 + 1
                for lo in range(0, len(rows), 1024):
                    part = rows[lo:lo + 1024]
                    cell = np.floor(np.stack([r[2] for r in part]) @ lines / width + shift).astype(np.int64).reshape(len(part), tables, k)
                    key = (cell * mult).sum(2) + np.int64(dim)
                    key = ((key ^ (key >> 29)) * mult[0] >> 31).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(r[0]) for r in part], pa.int64()), pa.array([r[1].tobytes() for r in part], pa.binary()),
                         pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(key.ravel()))], ["vec_id", "x", "cells"])
    return run


def _compare(cosine: float, kind: str):
    """Rows (t, cell, i, j, block, vec_id, x, cells, m) sorted by block pair -> (a, b, n): n links of a, or an edge a-b with n 0.

    A row stands for the m vectors that are equal to it."""
    def run(batches):
        for (t, _, i, j), rows in _by_key(batches, 4):
            block, ids = (rows.column(c).to_numpy().astype(np.int64) for c in (4, 5))
            if len(ids) < 2:
                continue
            raw = rows.column(6).to_pylist()
            x = np.zeros((len(ids), max(map(len, raw)) // np.dtype(kind).itemsize))
            dim = np.array([len(r) for r in raw])
            for r, v in enumerate(raw):
                v = unit(np.frombuffer(v, kind))
                x[r, :len(v)] = v
            cells = np.stack([c.values.to_numpy() for part in rows.column(7).chunks for c in part])[:, :t]
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            copies = rows.column(8).to_numpy().astype(np.int64)
            counts = np.zeros(len(ids), np.int64)
            parent = np.arange(len(ids))

            def root(v, parent=parent):
                while parent[v] != v:
                    parent[v] = v = parent[parent[v]]
                return v

            edges = []
            for lo in range(0, len(left), 256):
                part = left[lo:lo + 256]
                p, q = np.nonzero(x[part] @ x[right].T >= cosine - 1e-9)
                a, b = part[p], right[q]
                ok = (a < b) if i == j else np.ones(len(a), bool)
                a, b = a[ok], b[ok]
                # decided one by one: a matrix product may round otherwise than a dot product
                ok = (np.einsum("ij,ij->i", x[a], x[b]) >= cosine) & (dim[a] == dim[b]) & ~(cells[a] == cells[b]).any(1)
                a, b = a[ok], b[ok]
                np.add.at(counts, a, copies[b])
                np.add.at(counts, b, copies[a])
                for v, w in zip(a.tolist(), b.tolist(), strict=True):
                    r, s = root(v), root(w)
                    if r != s:
                        parent[r] = s
                        edges.append((v, w))
            has = np.flatnonzero(counts)
            if len(has):
                e = np.array(edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[has], ids[e[:, 0]]])), pa.array(np.concatenate([ids[has], ids[e[:, 1]]])),
                     pa.array(np.concatenate([counts[has], np.zeros(len(e), np.int64)]))], ["a", "b", "n"])
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, width: float = 2.25,
                 recall: float = 0.98, block: int = 1024, seed: int = 29) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing;
    vectors of different lengths don't link. Equal vectors link. Rows with a null id are left out,
    a repeated id counts as one vector (its first in bit order); other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")).where("vec_id is not null")
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    rows, rows_path = materialise(rows, "vectors")
    k, tables = plan(rows.count(), cosine, width, recall)
    kind = {"float": "<f4", "double": "<f8"}[rows.schema["embedding"].dataType.elementType.typeName()]
    hashed, hashed_path = materialise(rows.mapInArrow(_hash(k, tables, width, seed), "vec_id long, x binary, cells array<int>"), "vectors-hashed")
    # equal vectors meet once: the one of the least id stands for all, in every table
    alike, alike_path = materialise(hashed.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"), F.first("cells").alias("cells")), "vectors-alike")
    placed = alike.select("vec_id", F.posexplode("cells").alias("t", "cell"))
    size = placed.groupBy("t", "cell").agg(F.count("*").alias("n")).where("n > 1").select("t", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    spread = (placed.join(size, ["t", "cell"])
              .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("t", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id")
              .join(alike, "vec_id").select("t", "cell", "i", "j", "block", "vec_id", "x", "cells", "m"))
    found, found_path = materialise(
        spread.repartition("t", "cell", "i", "j").sortWithinPartitions("t", "cell", "i", "j").mapInArrow(_compare(cosine, kind), "a long, b long, n long"), "vectors-found")
    labels = connected_components(found.where("n = 0").select("a", "b"))
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    several = alike.where("m > 1").select("x", F.col("vec_id").alias("lead"), "m")
    of = hashed.select("vec_id", "x").join(several, "x", "inner").select(F.col("vec_id").alias("own"), "lead", "m")
    named = rows.select("vec_id").join(of, F.col("vec_id") == of["own"], "left").select("vec_id", F.coalesce("lead", "vec_id").alias("lead"), F.coalesce("m", F.lit(1)).alias("m"))
    result, _ = materialise(
        named.join(links, F.col("lead") == links["a"], "left").join(labels, F.col("lead") == labels["node"], "left")
        .select("vec_id", (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "lead").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id")), "vectors-result")
    for p in (rows_path, hashed_path, alike_path, found_path):
        drop_scratch(spark, p)
    return result
