"""Get-or-create with explicit codes against the walk over names in order."""

import random

import pytest

from seatwise.operators import dims


def derive(name, code):
    clean = name.strip()
    base = (code.strip() if code and code.strip() else clean).upper()[:20]
    if len(base) > 4 and not (code and code.strip()) and " " in clean:
        w = clean.replace("&", "").split()
        return "".join(x[0] for x in w).upper()[:10] if len(w) >= 2 else clean[:4].upper()
    return base


def walk(names, stored):
    rows, out = list(stored), {}
    for k, name, code in sorted(names):
        c, n = derive(name, code).lower(), name.strip().lower()
        hit = next((r for r in rows if c == r[2].lower() or n == r[2].lower() or n == r[1].lower()), None)
        if hit is None:
            hit = (max((r[0] for r in rows), default=0) + 1, name.strip(), derive(name, code))
            rows.append(hit)
        out[k] = hit[0]
    return out, rows[len(stored):]


@pytest.mark.parametrize("seed", range(5))
def test_codes_match_the_walk(spark, seed):
    rng = random.Random(seed)
    words = ["Foo Bar", "foo bar", "FB", "fb", " Foo", "Bar Baz", "BB", "X1", "x1", "Civil", "CIVIL", "Fine & Liberal Arts", "FLA", "a b", "A B"]
    names = [(k, rng.choice(words), rng.choice([None, None, "", " X1 ", "FB", "BB", "Foo", "a b", "civil"])) for k in rng.sample(range(1, 500), 60)]
    stored = [(3, "Bar Baz", "BARB"), (8, "Old", "FLA")][:seed % 3]
    got, new = dims.resolve(spark.createDataFrame(names, "row_no long, name string, code string"), spark.createDataFrame(stored, "id long, name string, code string"), code_col="code")
    want, made = walk(names, stored)
    assert {r["row_no"]: r["dim_id"] for r in got.collect()} == want
    assert sorted(tuple(r) for r in new.collect()) == made


def test_a_name_reuses_the_row_its_spelling_made(spark):
    names = spark.createDataFrame([(1, "Foo Bar", "X1"), (2, "Foo Bar", None)], "row_no long, name string, code string")
    got, new = dims.resolve(names, spark.createDataFrame([], "id long, name string, code string"), code_col="code")
    assert {r["dim_id"] for r in got.collect()} == {1} and [tuple(r) for r in new.collect()] == [(1, "Foo Bar", "X1")]
