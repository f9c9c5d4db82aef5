"""Header mapping (J1): raw file headers -> canonical roster fields.

Many files at once: input rows are (file, pos, header). Scores are computed set-based (every
header against the fixed alias dictionary, exploded in place, exact match first, LCS only for
pairs that can reach the threshold); the greedy choice -- headers in file order, each field used
once -- is a JVM-side fold (SQL ``aggregate``) over one file's headers (tens of rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.functions import text as T
from seatwise.operators.util import strip

THRESHOLD = 80.0  # inclusive: "SI.No." scores exactly 80 against "si no"

# Fixed values that must equal the original (field order, labels, required flags and aliases).
FIELDS = [
    ("usn", "USN / Registration No", False,
     ["usn", "usn number", "reg no", "registration number", "roll no", "roll number", "univ usn", "student usn"]),
    ("full_name", "Student Full Name", False,
     ["student full name", "full name", "student name", "candidate name", "name", "name of student", "first name",
      "student number", "student_name", "student_number"]),
    ("student_id", "Student ID", False,
     ["student id", "st_id", "id", "admission id", "enrollment id", "college id"]),
    ("student_number", "Student Serial No", False,
     ["student serial no", "stu no", "sr no", "sl no", "s.no", "si.no", "si.no."]),
    ("gender", "Gender", False,
     ["gender", "sex", "m/f", "m f", "gender (m/f)"]),
    ("department", "Branch / Department", False,
     ["branch / department", "department", "dept", "branch", "stream", "course branch", "dept name"]),
    ("program", "Program", False,
     ["program", "degree", "course", "program name"]),
]


def alias_array(fields=FIELDS):
    """The alias dictionary as one array literal of (field_idx, field, alias) structs."""
    return F.array(*[F.struct(F.lit(i).alias("field_idx"), F.lit(f).alias("field"), F.lit(a).alias("alias"))
                     for i, (f, _l, _r, aliases) in enumerate(fields) for a in aliases])


def header_scores(headers: DataFrame, fields=FIELDS, threshold: float = THRESHOLD) -> DataFrame:
    """Per (file, pos, field): exact flag and best fuzzy alias score (0 when below threshold).

    ``headers``: file, pos, header. Blank headers are dropped (they stay unmapped). Headers are
    stripped first (fix of Q13: padded headers are renamed by their stripped text).
    """
    h = (headers.withColumn("header", strip(F.col("header"))).where(F.col("header") != "")
         .withColumn("norm", T.normalise_header(F.col("header"))))
    # scores depend on the normalised text only: score each distinct text once, join back
    pairs = (h.select("norm").distinct()
             .select("norm", F.inline(alias_array(fields)))
             .withColumn("_sn", T.token_sort(F.col("norm"))).withColumn("_sa", T.token_sort(F.col("alias"))))
    exact = F.col("norm") == F.col("alias")
    ln, la = F.length("_sn"), F.length("_sa")
    bound = F.when((ln + la) == 0, F.lit(100.0)).otherwise(F.lit(200.0) * F.least(ln, la) / (ln + la))
    score = (F.when(exact, F.lit(100.0))
             .when(bound >= threshold, T.indel_ratio_vec(F.col("_sn"), F.col("_sa")))
             .otherwise(F.lit(0.0)))
    s = (pairs.withColumn("exact", exact).withColumn("score", score)
         .groupBy("norm", "field_idx", "field")
         .agg(F.max(F.col("exact").cast("int")).cast("boolean").alias("exact"), F.max("score").alias("best")))
    return h.join(s, "norm").select("file", "pos", "header", "field_idx", "field", "exact", "best")


def _choose(used, fields, threshold: float):
    """The field one header takes, given the fields already used in its file (SQL fold).

    Fields are visited in declared order, skipping used ones: an exact alias sets (field, 100)
    -- a later exact field overrides an earlier one, as in the original loop -- and otherwise a
    fuzzy score that beats the current best and reaches the threshold takes over.
    """
    init = F.struct(F.lit(None).cast("string").alias("k"), F.lit(0.0).alias("b"))

    def step(st, f):
        st1 = F.when(f["exact"], F.struct(f["field"].alias("k"), F.lit(100.0).alias("b"))).otherwise(st)
        take = (st1["b"] < 100.0) & (f["best"] > st1["b"]) & (f["best"] >= threshold)
        st2 = F.when(take, F.struct(f["field"].alias("k"), f["best"].alias("b"))).otherwise(st1)
        return F.when(F.array_contains(used, f["field"]), st).otherwise(st2)

    return F.aggregate(fields, init, step)


def map_headers(headers: DataFrame, fields=FIELDS, threshold: float = THRESHOLD) -> DataFrame:
    """J1 mapping: (file, pos, header, field, score) for every mapped header.

    The greedy walk over a file's headers in order is an SQL ``aggregate`` over that file's
    sorted header array (state: fields used so far, mappings made), evaluated on the JVM.
    A file's array holds its own headers only (tens), so no group grows with the data.
    """
    sc = header_scores(headers, fields, threshold)
    per_header = (sc.groupBy("file", "pos", "header")
                  .agg(F.array_sort(F.collect_list(F.struct("field_idx", "field", "exact", "best"))).alias("fs")))
    per_file = (per_header.groupBy("file")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "header", "fs"))).alias("hs")))
    out_t = "array<struct<pos:bigint,header:string,field:string,score:double>>"
    init = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(out_t).alias("out"))

    def walk(acc, h):
        ch = _choose(acc["used"], h["fs"], threshold)
        rec = F.struct(h["pos"].cast("long").alias("pos"), h["header"].alias("header"),
                       ch["k"].alias("field"), ch["b"].cast("double").alias("score"))
        return F.when(ch["k"].isNull(), acc).otherwise(
            F.struct(F.array_append(acc["used"], ch["k"]).alias("used"),
                     F.array_append(acc["out"], rec).alias("out")))

    folded = per_file.select("file", F.aggregate("hs", init, walk)["out"].alias("out"))
    return folded.select("file", F.inline("out"))


def unmapped(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Raw headers that received no field (blank ones included)."""
    h = headers.withColumn("_h", strip(F.col("header")))
    m = mapping.select("file", "pos")
    return h.join(m, ["file", "pos"], "left_anti").select("file", "pos", "header")


def missing_required(mapping: DataFrame, files: DataFrame, fields=FIELDS) -> DataFrame:
    """Per file, labels of required fields left unmapped (empty with the default table)."""
    req = [(f, label) for f, label, required, _a in fields if required]
    if not req:
        return files.select("file").limit(0).withColumn("label", F.lit(None).cast("string"))
    r = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(lab).alias("label")) for f, lab in req])
    need = files.select("file", F.inline(r))
    return need.join(mapping.select("file", "field"), ["file", "field"], "left_anti").select("file", "label")
