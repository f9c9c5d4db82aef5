"""Periodic runs against a comparison of all offsets, on adversarial word sequences."""

import re

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from seatwise.llm import runs
from seatwise.llm.queries import with_planted_runs

SCHEMA = "doc_id long, text string, row string, runs int, start int, collapsed string"


def truth(words, least=6, repeats=4):
    """(start, length, period) by comparing the sequence with itself at each offset."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, repeats * q))


def kept(words, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("ab", max_size=40), st.builds(lambda x, k, y: x * k + y, st.text("abc", min_size=1, max_size=6), st.integers(1, 9), st.text("abc", max_size=5))), max_size=4),
       st.sampled_from([(2, 2), (6, 4), (1, 3)]))
@example(["a" * 30, "a" * 30], (6, 4))
@example(["abaababaabaababaababaabaababaabaab"], (2, 2))
def test_runs_match_brute_force(texts, bounds):
    letters = np.array([1000 * k + ord(c) for k, x in enumerate(texts) for c in x], np.int64)
    got = list(zip(*(x.tolist() for x in runs.runs_of(letters, *bounds)), strict=True)) if len(letters) else []
    want, base = [], 0
    for x in texts:
        want += [(s + base, s + size + base, q) for s, size, q in truth(x, *bounds)]
        base += len(x)
    assert got == want


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_periodic_runs_edges(spark, block):
    texts = [None, "", " \t\n\x0b\x0c\r ", "x", "a b " * 40, "a b " * 40, "la " * 5, "la " * 6, "é è " * 4 + "tail é è é", "a\xa0b \x00 " * 9, "w" * 70_000 + " v" * 6,
             "one two three " * 3 + "one two", " ".join(f"u{k % 997}" for k in range(9000)), "a a a a b " * 5]
    rows = [(k, x, "r", 1, 2, "c") for k, x in enumerate(texts)] + [(None, "z " * 9, "r", 1, 2, "c"), (4, "other", "r", 1, 2, "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df, block=block).collect()), key=repr)
    want = []
    for r in rows:
        words = re.findall("[^\x20\x09-\x0d]+", r[1] or "")
        found = truth(words)
        want.append((r[0], len(words), found, kept(words, found)))
    assert got == sorted(want, key=repr)


def test_periodic_runs_empty_table_and_bounds(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert runs.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(empty, least_repeats=1)


def test_planted_runs_leave_other_rows_alone(spark):
    import zlib

    texts = {k: " ".join(f"w{j}" for j in range(k % 90)) for k in range(300)} | {1000: None}
    got = {r["doc_id"]: r["text"] for r in with_planted_runs(spark.createDataFrame([(k, x, "r", 1, 2, "c") for k, x in texts.items()], SCHEMA)).collect()}
    for k, x in texts.items():
        h = zlib.crc32(str(k).encode())
        words = (x or "").split()
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert (got[k] or "").split() == words
