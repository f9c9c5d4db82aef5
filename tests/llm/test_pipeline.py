"""Each stage of the pipeline, and all of them, against brute force: nulls, repeated ids, clashing columns, empty tables."""

import re
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from seatwise.llm import langid, toxicity

SF = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, n_chars long, key_id string, key_text int, kept string, lang_pred string, score string, row int, size int"


def bag(df):
    return sorted((tuple(r[c] for c in C.COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table's rows and hard ones, with columns whose names the stages use themselves."""
    rows = [tuple(r[c] for c in C.COLUMNS) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = rows[3][1]
    words = base.split(" ")
    near = " ".join([*words[:-1], "changed"])
    rows += [(None, base, "en", "n", 1), (None, None, None, None, None), (70_001, None, "de", "x", 0), (70_002, "", None, "x", 0), (70_003, "12 !?", "fr", "x", 5),
             (70_004, base + "\n", None, "copy", 9), (70_005, near, "en", "near", 9), (70_006, " \t ", "en", "x", 3), (70_007, "word " * 30_000, "en", "long", 9),
             (rows[5][0], rows[5][1], rows[5][2], "again", 1), (rows[6][0], "other text of a repeated id, quite short", None, "again", 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 3, "k", "xx", "s", 4, 5) for r in rows], WIDE).repartition(4)


def test_toxic_rows_go_and_no_others(spark, docs):
    df = frame(spark, docs)
    net = toxicity.train(df, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {(r["doc_id"], r["text"]) for r in toxicity.score(df, net, ("text",)).where("predicted = 1").collect()}
    want = sorted((r for r in docs if (r[0], r[1]) not in bad), key=repr)
    assert 0 < len(want) < len(docs)
    assert bag(C.drop_toxic(spark, df, SF)) == want


def test_rows_without_language_go(spark, docs):
    df = frame(spark, docs)
    model = langid.train(df)
    names, _ = model.classify([r[1] for r in docs])
    want = sorted(((*r[:2], r[2] or name, *r[3:]) for r, name in zip(docs, names, strict=True) if name != "und"), key=repr)
    gone = {r[0] for r in docs} - {r[0] for r in want}
    assert {70_001, 70_002, 70_003, 70_006} <= gone and all(not re.search(r"[^\W\d_]", r[1] or "") for r in docs if r[0] in gone)
    assert bag(C.drop_unknown_language(spark, df, SF)) == want


def of_groups(rows, groups, best):
    """Rows of ids that some group keeps, and rows with a null id."""
    kept = {best(g) for g in groups if g}
    return sorted((r for r in rows if r[0] is None or r[0] in kept), key=repr)


def test_one_of_each_text_stays(spark, docs):
    groups = defaultdict(list)
    for r in docs:
        groups[re.sub("[\x20\x09-\x0d]", "", r[1] or "")].append(r)
    want = of_groups(docs, [[r for r in g if r[0] is not None] for g in groups.values()], lambda g: min(g, key=lambda r: (-len(r[1] or ""), r[0]))[0])
    got = bag(C.drop_exact_copies(spark, frame(spark, docs), SF))
    assert got == want and len(got) < len(docs)


def test_one_of_each_near_group_stays(spark, docs):
    rows = [r for r in docs if r[0] not in (docs[5][0], docs[6][0])]  # ids once: a group is of ids
    sets = {}
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        if r[0] is not None:
            sets[r[0]] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1:]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    want = sorted((r for r in rows if r[0] is None or root(r[0]) == r[0]), key=repr)
    got = bag(C.drop_near_copies(spark, frame(spark, rows), SF))
    assert got == want and len(got) < len(rows)


def packed_right(pieces, rows):
    """Every document's ids in pieces, sequences gapless and at most 1024 long."""
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = defaultdict(list)
    for r in rows:
        size[r[0]].append(len(coder.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    got, filled = defaultdict(int), defaultdict(list)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
    assert {k: sum(v) for k, v in size.items()} == dict(got)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(sum, size.values()))
    assert len(filled) <= 1.01 * -(-total // 1024) + 1 or not rows


def test_pieces_hold_every_row(spark, docs):
    packed_right(C.pack(spark, frame(spark, docs), SF).collect(), docs)


def test_run_is_the_stages_one_after_another(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    at = []
    for _, stage in C.STAGES[:-1]:
        before = df
        df = stage(spark, df, SF)
        assert df.columns == list(C.COLUMNS)
        df = spark.createDataFrame(df.collect(), before.schema)
        at.append(df.count())
    assert at == sorted(at, reverse=True) and at[-1] > 0.5 * at[0]
    packed_right(C.run(spark, SF).collect(), [tuple(r[c] for c in C.COLUMNS) for r in df.collect()])


def test_empty_tables_stay_empty(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in C.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert C.run(spark, str(tmp_path)).count() == 0
