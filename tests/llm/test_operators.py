"""The queries against brute force on the smallest tables, and the edge cases of each operator."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seatwise.llm import bpe, chat, embeddings, exact, jaccard, langid, licenses, packing, queries, toxicity, warc
from seatwise.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid long, a long, component string"
LONG = "word " * 30_000


def docs_of(spark, texts):
    return spark.createDataFrame([(k, x, None, None, None, 7, 7, "x") for k, x in enumerate(texts)], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def find(parent, x):
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def shingle_set(text, width=4):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_truth(texts, percent=85):
    sets = {k: shingle_set(x) for k, x in texts.items()}
    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    parent = {k: k for k in texts}
    for k, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                x, y = find(parent, k), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(parent, k)) for k in texts}


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_matches_brute_force(spark, block):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    for k in range(60):  # near copies at all distances, none a hub
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts[10_000 + k] = " ".join(own)
    texts |= {20_000: None, 20_001: "", 20_002: " \t\n", 20_003: "a b", 20_004: "A\tB", 20_005: "b a", 20_006: LONG, 20_007: LONG + "word", 20_008: "a b c d"}
    df = spark.createDataFrame([(k, x, "x", 1) for k, x in texts.items()], "doc_id long, text string, sid string, lead long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard.jaccard_groups(df, block=block))}
    assert got == jaccard_truth(texts)


def test_jaccard_empty_table(spark):
    assert rows(jaccard.jaccard_groups(docs_of(spark, []))) == []


def test_jaccard_leads_without_a_window(spark):
    rng = random.Random(4)
    held = sorted({(rng.randrange(30), rng.randrange(1, 200)) for _ in range(900)} | {(99, k) for k in range(1, 200)})
    entries = spark.createDataFrame([(*h, 5) for h in held + held[:50]], "sig long, sid long, size long")
    degree = entries.groupBy("sid").count().withColumnRenamed("count", "degree")
    n = Counter(sid for _, sid in held + held[:50])
    leads = {g: min((sid for s, sid in held if s == g), key=lambda k: (-n[k], k)) for g, _ in held}
    family = jaccard._families(entries, degree)
    got = [tuple(r) for r in family.collect()]
    assert len(got) == len(set(got)) and set(got) == {(leads[g], sid) for g, sid in held}
    assert "Window" not in family._jdf.queryExecution().toString()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 10**6))
def test_linked_sets_share_a_signature(size, changes, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(1, 2**63, size, dtype=np.uint64))
    keep = x[rng.permutation(len(x))[:max(1, len(x) - changes // 2)]]
    y = np.unique(np.concatenate([keep, rng.integers(1, 2**63, changes - changes // 2, dtype=np.uint64)]))
    if not jaccard.linked(x, y, 85):
        return
    sig, own = jaccard.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), jaccard.Bands(85))
    assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())
    flips, at = jaccard.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    p, q = flips[at[0]:at[1]].tobytes(), flips[at[1]:at[2]].tobytes()
    n = min(len(p), len(q))
    apart = int(np.bitwise_count(jaccard._fold(p, n) ^ jaccard._fold(q, n)).sum())
    assert apart <= len(np.setxor1d(x, y)) <= jaccard._bound(len(x), len(y), 85)


def test_components_of_a_long_chain(spark):
    n = 1000
    e = spark.range(n).selectExpr("id as a", "id + 1 as b")
    assert {(r["node"], r["component"]) for r in rows(connected_components(e))} == {(k, 0) for k in range(n + 1)}
    e = spark.createDataFrame([(1, 1), (None, 2), (3, None), (5, 4), (5, 4)], "a long, b long")
    assert {(r["node"], r["component"]) for r in rows(connected_components(e))} == {(4, 4), (5, 4)}


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.2, np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.15])
    data = [(k, [float(v) for v in r], "l", k) for k, r in enumerate(x)]
    data += [(900, None, None, 1), (901, [], None, 1), (902, [0.0] * 16, None, 1), (903, [1.0, None] * 8, None, 1), (904, [float("nan")] * 16, None, 1),
             (905, [float("inf")] + [1.0] * 15, None, 1), (906, [1.0, 2.0], None, 1), (907, [2.0, 4.0], None, 1), (908, data[0][1], None, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string, t int")
    x = np.concatenate([x, x[:1]])
    ids = [*range(len(x) - 1), 908]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    for block in (1024, 8):
        got = {r["vec_id"]: r for r in rows(embeddings.near_vectors(df, recall=0.9999, block=block))}
        assert len(got) == len(data)
        parent = {k: k for k in range(len(x))}
        for i, j in zip(*np.nonzero(near), strict=True):
            p, q = find(parent, i), find(parent, j)
            parent[max(p, q)] = min(p, q)
        for k, v in enumerate(ids):
            assert got[v]["n_links"] == near[k].sum() - 1
            assert got[v]["component_id"] == ids[find(parent, k)]
            assert got[v]["kept"] == (got[v]["component_id"] == v)
        assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 906))
        assert got[906]["n_links"] == got[907]["n_links"] == 1
    assert rows(embeddings.near_vectors(df.limit(0))) == []


def test_vectors_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = df.toPandas().sort_values("vec_id")
    x = np.stack(p["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = (x @ x.T >= 0.9).sum(1) - 1
    got = embeddings.near_vectors(df).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() <= true).all()
    assert got["n_links"].sum() >= 0.9 * true.sum()


def test_toxicity_edges_and_learning(spark):
    rng = random.Random(5)
    clean = [" ".join(rng.choice(["the", "sun", "is", "out", "and", "warm"]) for _ in range(40)) for _ in range(200)]
    texts = [x + (" you vile toad" if k % 3 == 0 else "") for k, x in enumerate(clean)] + [None, "", "!!!", LONG, LONG + " vile toad"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)] + [(201, None), (999, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in rows(toxicity.toxicity(docs, labels))}
    assert len(got) == len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [k for k in range(200) if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == int(k % 3 == 0) for k in held) >= 0.95 * len(held)
    assert got[200]["score"] == got[201]["score"] == got[202]["score"]
    assert rows(toxicity.toxicity(docs.limit(0), labels)) == []
    assert len(rows(toxicity.toxicity(docs, labels.limit(0)))) == len(texts)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in rows(langid.language_id(docs))}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [k for k in got if got[k]["held_out"]]
    assert held == [k for k in got if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(got[k]["lang_pred"] == lang[k] for k in held) >= 0.97 * len(held)
    model = langid.train(docs)
    extra = docs_of(spark, [None, "", "123 .,!", "  ", "Ñandú", LONG])
    names = [r["lang_pred"] for r in sorted(rows(langid.identify(extra, model)), key=lambda r: r["doc_id"])]
    assert names[:4] == ["und"] * 4 and all(x in model.languages for x in names[4:])
    assert rows(langid.language_id(docs.limit(0))) == []
    assert {r["lang_pred"] for r in rows(langid.language_id(extra))} == {"und"}


def greedy_phrases(text, known):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


@settings(max_examples=40, deadline=None)
@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", min_size=0, max_size=120))
def test_cross_parsing_is_greedy_longest_match(known, text):
    model = langid.Model({"x": known}, 63)
    symbols = "".join(chr(65 + c) for c in model.symbol[langid.points(known)])
    shown = "".join(chr(65 + c) for c in model.symbol[langid.points(text)])
    codes = model.symbol[langid.points(text)]
    got = model.phrases(codes, np.array([0, len(codes)]))[0, 0]
    assert got == greedy_phrases(shown, symbols)


def test_exact_dedup(spark):
    texts = ["a b", "ab", "a  b", None, "", " \n", "Ab", LONG, LONG, "é", "a\x85b"]
    docs = docs_of(spark, texts)
    index = exact.DigestIndex(spark, exact.scratch_path(spark, "index"), 4)
    got = {r["doc_id"]: r for r in rows(exact.dedup_append(docs, index))}
    norm = [re.sub(r"[\x20\x09-\x0d]", "", x or "") for x in texts]
    for k, r in got.items():
        same = [j for j in range(len(texts)) if norm[j] == norm[k]]
        best = min(same, key=lambda j: (-len(texts[j] or ""), j))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(same), best == k)
        assert r["text_sha256"] == hashlib.sha256(norm[k].encode()).hexdigest()
    size = index.scan().count()
    again = rows(exact.dedup_append(docs, index))  # a repeated batch appends nothing and decides alike
    assert index.scan().count() == size and {r["doc_id"]: r for r in again} == got
    later = rows(exact.dedup_append(spark.createDataFrame([(100, "a   b"), (101, "new")], "doc_id long, text string"), index))
    assert {(r["doc_id"], r["kept"], r["keep_id"]) for r in later} == {(100, False, 2), (101, True, 101)}
    again = exact.DigestIndex(spark, index.path, 4)
    assert again.rows().count() == size + 1
    assert rows(exact.dedup_append(docs.limit(0), index)) == []


def test_exact_dedup_keeps_a_named_copy(spark):
    docs = spark.createDataFrame([(None, "a   b"), (7, "a b"), (8, "ab"), (5, "ab"), (None, "x y"), (None, " ")], "doc_id long, text string")
    index = exact.fresh_index(spark)
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows(exact.dedup_append(docs, index))}
    assert got == {(None, 7, 4, False), (7, 7, 4, True), (8, 7, 4, False), (5, 7, 4, False), (None, None, 1, False)}
    later = rows(exact.dedup_append(spark.createDataFrame([(9, "xy"), (10, "ab")], "doc_id long, text string"), index))
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in later} == {(9, 9, True), (10, 7, False)}


def test_chat_layouts_and_round_trip(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "noise": {"role": 1}}),
        (2, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}),
        (3, {"prompt": "hi", "completion": "yo"}), (4, {"prompt": "hi", "response": "yo", "system": None}),
        (5, {"instruction": "hi", "input": "", "output": "yo"}), (6, {"answer": "yo", "question": "hi"}), (7, {"other": 1}), (8, None)]
    df = spark.createDataFrame([(k, json.dumps(r) if r else "{broken") for k, r in records] + [(9, None)], "conv_id long, record string")
    got = defaultdict(list)
    for r in sorted(rows(chat.from_json(df)), key=lambda r: (r["conv_id"], r["turn"])):
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(got) == {k: [("user", "hi"), ("assistant", "yo")] for k in range(1, 7)}
    nasty = ["", None, "<|im_end|>\n", "<\\|", "\\<|", "\\\\<|x", "<|im_start|>assistant\nhm", "é<", "|", "\n", "<\\n", LONG]
    turns = [(k, t, role, nasty[(k + t) % len(nasty)]) for k in range(len(nasty)) for t, role in enumerate(["system", "user", "assistant", "a\nb<|", None, "assistant"])]
    turns += [(50, None, "user", "x"), (50, 1, "user", "x"), (50, 1, "user", "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, n string")
    out = chat.format_chats(chat.from_table(df))
    read = out.select("conv_id", chat.read_turns(out["formatted"]).alias("turns"), chat.read_loss(out["formatted"], out["loss"]).alias("learned"))
    want = defaultdict(list)
    for k, t, role, text in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[k].append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in r["turns"]] for r in rows(read)} == dict(want)
    assert {r["conv_id"]: r["learned"] for r in rows(read)} == {k: "".join(x for r, x in v if r == "assistant") for k, v in want.items()}
    with pytest.raises(ValueError):
        chat.from_table(spark.createDataFrame([(1, 2)], "conv_id long, x long"))
    assert rows(chat.format_chats(chat.from_table(df.limit(0)))) == []


def check_packing(got, texts, coder, size=1024):
    spans, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
    assert by_doc.keys() == texts.keys()
    total = 0
    for k, text in texts.items():
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        own = sorted(by_doc[k], key=lambda r: r["piece"])
        for p, r in enumerate(own):
            assert (r["piece"], r["start"]) == (p, at) and (p == 0 or r["length"] == size)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and len(own) == -(-len(ids) // size)
    return len(spans), -(-total // size)


def test_packing(spark):
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    used, least = check_packing(rows(queries.op7_packing(spark, SF)), texts, coder)
    assert used <= least * 1.01 + 1
    odd = [None, "", "<|endoftext|> x", "日本 　 x", "a\x1c b\x85", LONG, "x" * 30_000, "é ​"]
    got = rows(packing.pack(docs_of(spark, odd), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    check_packing(got, dict(enumerate(odd)), coder)
    assert rows(packing.pack(docs_of(spark, []), P.path("byte_bpe_50k.json"))) == []


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plan_packs_the_histogram_exactly(counts):
    planned = packing.plan(counts, 64)
    assert all(sum(p) <= 64 and n > 0 for p, n in planned)
    packed = Counter()
    for p, n in planned:
        for v in p:
            packed[v] += n
    assert packed == Counter(counts)


def test_warc(spark):
    big = "é" * 600
    pages = [(1, "http://a/", big, 1), (2, "http://b/", big, 2), (3, None, big, 2), (4, "x\r\ny", "", 2), (5, "u", None, 2), (6, "u", "s", 2), (7, "u", "s", 2),
             (8, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n", 3), (9, "u", LONG, 3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest long")
    got = {r["page_id"]: r for r in rows(warc.round_trip(df))}
    assert len(got) == len(pages)
    for k, _, html, _ in pages:
        raw = (html or "").encode()
        twins = [p for p, _, h, _ in pages if len(raw) >= 1000 and (h or "").encode() == raw]
        want = (len(raw), hashlib.sha1(raw).hexdigest(), "response" if not twins or max(twins) == k else "revisit", max(twins) if twins and max(twins) != k else None)
        assert tuple(got[k].values())[1:] == want
    assert rows(warc.round_trip(df.limit(0))) == []
    written = warc.write_archives(df.repartition(1), warc.scratch_path(spark, "warc"), per_file=1)
    assert written.count() == len(pages)


def test_license_scan(spark):
    texts = ["foo bar. Released under the MIT License. baz", None, "", "mit license", "x " * 500 + "Licensed under the Apache License, Version 2.0." + " y" * 40,
             "This work is licensed under the GNU General Public License, version 2.", ("Released under the MIT License. " * 50), "nothing to see in this text at all"]
    got = {(r["doc_id"], r["license"]) for r in rows(licenses.license_scan(docs_of(spark, texts), licenses.notices(spark)))}
    assert got == {(0, "MIT"), (4, "Apache-2.0"), (5, "GPL-3.0"), (6, "MIT")}
    assert rows(licenses.license_scan(docs_of(spark, []), licenses.notices(spark))) == []
    assert rows(licenses.license_scan(docs_of(spark, texts), licenses.notices(spark).limit(0))) == []


def check_license_sql(spark, texts):
    import duckdb
    import pandas as pd

    docs = docs_of(spark, texts)
    cols = ["doc_id", "template_id", "license", "n_matched", "n_template", "containment", "first_pos"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE['op9_license_scan']}) x").fetchall()
    got = [tuple(r) for r in licenses.license_scan(docs, licenses.notices(spark)).select(*cols).collect()]
    assert len(got) == len(set(got)) and set(got) == set(want)
    return got


def test_license_scan_finds_adjacent_notices(spark):
    lines = [x for _, x in licenses.NOTICES[:6]]
    texts = [" ".join(["word"] * at + list(p)) for p in itertools.permutations(lines, 3) for at in range(16)]
    texts += [" ".join(["word"] * at + list(p)) for p in itertools.permutations(lines, 4) for at in (0, 5, 160, 171)]
    texts += ["This work is licensed under the x y of Public License version 3 x the GNU General Public License"]  # in pieces
    got = Counter(r[0] for r in check_license_sql(spark, texts))
    assert all(got[k] >= 3 for k in range(len(texts) - 1))


def test_license_scan_finds_license_bodies(spark):
    rng = random.Random(9)
    texts, want = [], []
    for k, (name, text) in enumerate(licenses.NOTICES):
        words = text.split()
        for changed in (0, len(words) // 60):
            own = list(words)
            for at in rng.sample(range(len(own)), changed):
                own[at] = "other"
            texts.append(" ".join(["word"] * rng.randrange(700) + ["Copyright 2020 A. Person."] + own + ["x"] * rng.randrange(90)))
            want.append((name, k + 1))
    texts += [" ".join(x for _, x in rng.sample(licenses.NOTICES, 12)) for _ in range(150)]
    found = {(r[0], r[2], r[1]) for r in check_license_sql(spark, texts)}
    assert all((k, *w) in found for k, w in enumerate(want))
    named = {name for name, _ in licenses.NOTICES}
    assert named >= {"BSD-2-Clause", "BSD-3-Clause", "ISC", "LGPL-2.1", "AGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0"}


def test_bpe_query(spark):
    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = [None, "", " ", "It's we'll O'REILLY 'Re", "<|startoftext|>Hi<|endoftext|>", "日本語 x", "ΣΑΣ İ", "½²a_b", "a\x1cb\x85c", "éÉ", "x" * 5000 + "ü" * 3000, LONG]
    texts = dict(enumerate(odd)) | {r["doc_id"] + 100: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("ids", bpe.F.lit(1))
    got = {r["doc_id"]: r for r in rows(bpe.encode_digests(df, P.path("word_bpe_49k.json")))}
    assert got.keys() == texts.keys()
    for k, x in texts.items():
        ids = coder.encode(x or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), x
        assert got[k]["decoded_sha256"] == hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()


CODER = bpe.Coder(P.path("word_bpe_49k.json"))


@settings(max_examples=60, deadline=None)
@given(st.text("abcdestho", min_size=1, max_size=300), st.integers(1, 12))
def test_tree_concatenation_is_the_whole_encoding(run, leaf):
    assert CODER.tree(run, leaf) == CODER.closed.encode(run).ids
