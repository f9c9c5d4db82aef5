import random

from pyspark.sql import functions as F

from seatwise.functions import text as T
from seatwise.operators import dims, mapping, upsert


def _headers(spark, file, hs):
    return spark.createDataFrame([(file, i, h) for i, h in enumerate(hs)], "file string, pos long, header string")


def test_each_header_takes_the_best_field_that_is_left(spark):
    """Exact spellings, near ones, one at the threshold, a field used up by an earlier header, and strangers."""
    cases = [("Roll-No", "usn", 100.0), ("Enrollment_ID", "student_id", 100.0), ("Stream:", "department", None), ("Genders", "gender", None),
             ("progam name", "program", None), ("Sex", None, None), ("Blood Group", None, None), ("NAME OF STUDENT", "full_name", 100.0), ("si no.", "student_number", None)]
    h = _headers(spark, "upload.csv", [c[0] for c in cases])
    mapped = mapping.map_headers(h)
    got = {r["header"]: (r["field"], r["score"]) for r in mapped.collect()}
    assert {k: f for k, (f, _) in got.items()} == {c[0]: c[1] for c in cases if c[1]}
    assert all(got[name][1] == score for name, _, score in cases if score)
    assert all(80 <= got[c[0]][1] < 100 for c in cases if c[1] and not c[2] and c[0] not in ("Stream:", "si no."))
    assert {r["header"] for r in mapping.unmapped(h, mapped).collect()} == {"Sex", "Blood Group"}
    needed = [(f, label, f in ("usn", "program"), a) for f, label, _r, a in mapping.FIELDS]
    without = mapping.map_headers(h.where("header <> 'progam name'"), needed)
    assert [r["label"] for r in mapping.missing_required(without, h.select("file").distinct(), needed).collect()] == ["Program"]


def test_map_quirks(spark):
    # "SI.No." scores exactly 80 (inclusive threshold); "student number" takes the name field first
    h = _headers(spark, "f2", ["SI.No.", "student number", "Student Name", "  Gender  ", ""])
    m = {r["header"]: (r["field"], r["score"]) for r in mapping.map_headers(h).collect()}
    assert m["SI.No."][0] == "student_number"
    assert m["student number"][0] == "full_name"
    assert "Student Name" not in m
    assert m["Gender"] == ("gender", 100.0)


def test_map_many_files_independent(spark):
    a = _headers(spark, "a", ["Name", "USN"])
    b = _headers(spark, "b", ["USN", "Name", "Sex"])
    m = {(r["file"], r["header"]): r["field"] for r in mapping.map_headers(a.unionByName(b)).collect()}
    assert m == {("a", "Name"): "full_name", ("a", "USN"): "usn", ("b", "USN"): "usn",
                 ("b", "Name"): "full_name", ("b", "Sex"): "gender"}


def test_similarity_sql_and_vector_agree(spark):
    rnd = random.Random(3)
    pairs = [("branch department", "branch / department")] + [
        ("".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 20))),
         "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 20)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(T.indel_ratio(F.col("a"), F.col("b")).alias("s"),
                     T.indel_ratio_vec(F.col("a"), F.col("b")).alias("v")).collect()
    assert all(abs(r["s"] - r["v"]) < 1e-9 for r in rows)
    assert abs(T._indel_ratio_series(["branch department"], ["branch / department"])[0] - 94.4444444) < 1e-6


def test_a_name_finds_its_row_by_code_by_name_or_makes_one(spark):
    stored = spark.createDataFrame([(4, "Marine Biology", "MB"), (9, "Law", "LAW")], "id long, name string, code string")
    names = spark.createDataFrame([(10, "mb"), (11, "  marine biology"), (12, "Music & Ballet"), (13, "History of Art"), (14, "HOA"), (15, "history  of art"), (16, "Botany"), (17, "law")],
                                  "row_no long, name string")
    out, new = dims.resolve(names, stored)
    assert {r["row_no"]: r["dim_id"] for r in out.collect()} == {10: 4, 11: 4, 12: 4, 13: 10, 14: 10, 15: 10, 16: 11, 17: 9}
    assert {tuple(r) for r in new.collect()} == {(10, "History of Art", "HOA"), (11, "Botany", "BOTANY")}
    again, none = dims.resolve(names, stored.unionByName(new))
    assert {r["dim_id"] for r in again.collect()} == {4, 9, 10, 11} and none.count() == 0


def _seq_upsert(rows, stored):
    """Sequential model of the import map walk: returns {row_no: (kind, entity)}."""
    umap, imap = {}, {}
    for s in sorted(stored, key=lambda s: s["id"]):
        umap[s["usn"].strip().upper()] = ("old", s["id"])
        imap[s["student_id"].strip().upper()] = ("old", s["id"])
    out = {}
    for r in sorted(rows, key=lambda r: r["row_no"]):
        u, i = r["usn"].strip().upper(), r["sid"].strip().upper()
        e = umap.get(u) or imap.get(i) or ("new", r["row_no"])
        umap[u] = e
        imap[i] = e
        out[r["row_no"]] = e
    return out


def test_upsert_resolution_matches_sequential(spark):
    rnd = random.Random(11)
    stored = [{"id": i, "usn": f"U{i}", "student_id": f"S{i}"} for i in range(1, 15)]
    rows = []
    for n in range(1, 120):
        u = f"U{rnd.randint(1, 25)}" if rnd.random() < 0.8 else ""
        s = f"S{rnd.randint(1, 25)}" if rnd.random() < 0.6 else ""
        rows.append({"row_no": n, "usn": u, "sid": s})
    batch = spark.createDataFrame([(r["row_no"], r["usn"] or None, r["sid"] or None, "Dept X", "m") for r in rows],
                                  "row_no long, usn string, student_id string, department string, gender string")
    clean = upsert.clean_batch(batch, "7")
    cl = {r["row_no"]: r for r in clean.collect()}
    target = spark.createDataFrame([(s["id"], s["usn"], s["student_id"]) for s in stored],
                                   "id long, usn string, student_id string")
    ent = {r["row_no"]: ("new" if r["is_new"] else "old", r["entity"])
           for r in clean.join(upsert.resolve_keys(clean, target), "ukey").collect()}
    model = _seq_upsert([{"row_no": k, "usn": v["usn"], "sid": v["student_id"]} for k, v in cl.items()], stored)
    assert ent == model


def test_clean_rules(spark):
    b = spark.createDataFrame([
        (1, " 1DS21 ", None, None, None, None, " F "),
        (2, None, "ID9", "Ann", "CSE", "", "woman"),
        (3, "null", None, "nan", "NONE", None, None),
    ], "row_no long, usn string, student_id string, full_name string, department string, program string, gender string")
    got = {r["row_no"]: r for r in upsert.clean_batch(b, "12").collect()}
    assert (got[1]["usn"], got[1]["student_id"], got[1]["full_name"], got[1]["department"], got[1]["program"],
            got[1]["gender"]) == ("1DS21", "1DS21", "1DS21", "General", "B.Tech", "Female")
    assert (got[2]["usn"], got[2]["student_id"], got[2]["program"], got[2]["gender"]) == ("ID9", "ID9", "", "Female")
    assert (got[3]["usn"], got[3]["student_id"], got[3]["full_name"], got[3]["department"]) == \
        ("STU_12_0003", "STU_12_0003", "STU_12_0003", "General")
