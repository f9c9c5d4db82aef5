"""Groups of equal vectors in the Euclidean hashing: links counted by copies, compared once."""

import numpy as np

from seatwise.llm import embeddings


def test_equal_vectors_count_as_links_of_each_other(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16)).astype(np.float32)
    base[1] = base[0] + np.float32(0.05)  # near the hot one
    rows, owner = [], []
    for k, copies in enumerate((3000, 2, 40, 1, 1, 1)):
        for _ in range(copies):
            rows.append((len(rows) * 3 + 1, base[k].tolist(), "x", 1))
            owner.append(k)
    rows += [(90_000, None, "x", 1), (90_001, [0.0] * 16, "x", 1), (90_002, [0.0] * 16, "x", 1), (90_003, [float("nan")] * 16, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, lead string, m int").repartition(7)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    x = np.stack([embeddings.unit(b) for b in base])
    near = x @ x.T >= 0.9
    counts = np.bincount(owner)
    first = {k: 3 * owner.index(k) + 1 for k in range(6)}
    for (vec, *_), k in zip(rows, owner, strict=False):
        least = min(first[j] for j in range(6) if near[k, j])
        assert got[vec] == (int(counts[near[k]].sum()) - 1, least, vec == least)
    assert near[0, 1] and all(got[v] == (0, v, True) for v in range(90_000, 90_004))
