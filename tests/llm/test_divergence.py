"""Source divergence against a brute-force version: exact integers, hot and empty groups, tiles, nulls."""

import random
import re
from collections import Counter, defaultdict

import pytest

from seatwise.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long, bits string, value string"


def truth(docs, least=3, top=200):
    terms = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")] for _, t, _, _ in docs]
    held, used, groups = defaultdict(Counter), defaultdict(Counter), set()
    for words, (_, _, lang, source) in zip(terms, docs, strict=True):
        groups.add((lang or "", source or ""))
        held[lang or ""].update(set(words))
        used[lang or "", source or ""].update(words)
    out = set()
    kept = {lang: sorted(w for w, n in held[lang].items() if n >= least) for lang in {g[0] for g in groups}}

    def ps(count, lang):
        size = sum(count[w] for w in kept[lang]) + len(kept[lang])
        return {w: 1 + 1_000_000_000 * (count[w] + 1) // size for w in kept[lang]}

    of = {g: ps(used[g], g[0]) for g in groups}
    for lang, source in groups:
        whole = ps(sum((used[g] for g in groups if g[0] == lang), Counter()), lang)
        p = of[lang, source]
        pair = [(sum((p[w] - q[w]) ** 2 // q[w] for w in p), h) for (x, h), q in of.items() if x == lang and h != source]
        term = [((p[w] - whole[w]) ** 2 // whole[w], w) for w in p if used[lang, source][w] and p[w] > whole[w]]
        for part, found in (("pair", pair), ("term", term)):
            for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))):
                if part == "pair" or k < top:
                    out.add((lang, source, part, item, v, k + 1))
    return out


def found(spark, docs, **how):
    df = spark.createDataFrame([(*d, "x", 7, "y", "z") for d in docs], SCHEMA)
    out = [tuple(r) for r in divergence.source_divergence(df, **how).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("tile", [64, 2])
def test_divergence_matches_brute_force(spark, tile):
    rng = random.Random(5)
    words = [f"W{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(300)]
    docs = []
    for k in range(400):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if k % 3 == 0 else f"s{rng.randrange(7)}"
        docs.append((k, " ".join(words[int(300 * rng.random() ** 3)] for _ in range(rng.randrange(60))) + "1x2", lang, source))
    docs += [(7, docs[7][1], "en", "twin"), (7, docs[7][1], "en", "twin"), (None, None, "en", None), (500, "", "xx", "alone"), (501, "rare", "yy", "a"), (502, "", "yy", "b")]
    docs += [(k, "the " * 5000 + "A_bK \U0001f600 " + "solo" * 3000, "zz", f"long{k % 2}") for k in range(600, 604)]
    assert found(spark, docs, tile=tile, top=9) == truth(docs, top=9)


def test_divergence_without_terms_or_rows(spark):
    assert found(spark, []) == set()
    docs = [(1, None, None, None), (2, "", "", "b"), (3, "12 !!", None, "c")]
    assert found(spark, docs) == truth(docs)
    assert {r[4] for r in truth(docs)} == {0}


def test_divergence_of_a_source_for_each_row(spark):
    docs = [(k, "same words in each " + "x" * (k % 5 + 1), "en", f"s{k:03}") for k in range(150)]
    assert found(spark, docs, tile=16) == truth(docs)
