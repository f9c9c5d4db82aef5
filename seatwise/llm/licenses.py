"""License scan, in DataFrame operations only.

A text's words ``[a-z0-9]+`` give shingles of five words. Shingles that occur in no template can
only dilute a window, so they go by a join with the templates' shingles before anything moves.
What is left falls into overlapping windows of ``span`` positions, a new one every half span, and
half a span is at least as long as the longest template, so every whole occurrence lies within a
window. Templates fall into length classes: class c holds those of 2 ** c to 2 ** (c + 1) - 1
distinct shingles, and for each class a window is cut into pieces of 2 ** c positions that keep
the shingles of that class's templates only. Each piece and each template has one minimum hash a
band; an equal minimum in any piece retrieves the template for the window.

Of a template with n shingles let k be in the window, wherever they lie there. A band retrieves it
when the template's least shingle is one of the k and is also the least of its piece; a piece of
w <= n positions adds at most w - 1 shingles, so a band does with a chance of at least
k / (n + w - 1), and all bands miss with (1 - k / (n + w - 1)) ** bands. The number of bands makes
that at most ``miss`` for the least k that counts as found, whatever other templates stand beside
it (at 80% the chance a band is above 0.4). Candidates are decided by exact containment of the
template's shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm.passages import PASSAGES

# fixed values: first lines, notices and passages of public licenses
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *PASSAGES,
)


def notices(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(k + 1).cast("long").alias("template_id"), F.lit(name).alias("license"), F.lit(text).alias("text")) for k, (name, text) in enumerate(NOTICES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _placed(df: DataFrame, key: str, width: int) -> DataFrame:
    words = df.withColumn("w", F.array_remove(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[^a-z0-9]+"), ""))
    last = F.size("w") - width
    hashed = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                           lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(width)])))
    return words.select(key, F.posexplode(hashed).alias("pos", "h"))


def license_scan(docs: DataFrame, templates: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-9,
                 broadcast_shingles: int = 1_000_000) -> DataFrame:
    """(doc_id, template_id, license, n_matched, n_template, containment, first_pos): templates found in each document.

    A template is found when a window holds ``percent`` of its distinct shingles; the best window
    counts, ties by position. Null and empty texts and texts of fewer than ``width`` words hold
    none; so do templates that short. Rows with a null id are left out, a repeated id is one
    document; other columns are ignored; an empty table gives an empty result.
    """
    t = templates.select(F.col("template_id").cast("long").alias("template_id"), F.col("license").cast("string").alias("license"), "text")
    named = t.select("template_id", "license").where("template_id is not null").dropDuplicates(["template_id"])
    known = _placed(t, "template_id", width).select("template_id", "h").distinct()
    sizes = known.groupBy("template_id").agg(F.count("*").alias("n_template"))
    classed = sizes.withColumn("cls", F.length(F.bin("n_template")) - 1)
    least = F.greatest(F.lit(1), F.ceil(F.col("n_template") * percent / 100))
    longest, chance = classed.agg(F.max("n_template"), F.min(least / (F.col("n_template") + F.expr("shiftleft(1L, cls)") - 1))).first()  # two numbers
    half = max(16, longest or 1)
    bands = math.ceil(math.log(miss) / math.log1p(-chance)) if chance and chance < 1 else 1
    known = known.join(classed.select("template_id", "cls"), "template_id")
    domain = known.groupBy("h").agg(F.array_sort(F.collect_set("cls")).alias("classes"))
    if domain.count() <= broadcast_shingles:  # tens of bytes each; beyond that a shuffle join
        domain = F.broadcast(domain)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    hits = _placed(rows, "doc_id", width).join(domain, "h").select("doc_id", "pos", "h", "classes")
    windows = hits.select("doc_id", "pos", "h", "classes", F.explode(F.array_distinct(F.array(F.floor(F.col("pos") / half), F.greatest(F.floor(F.col("pos") / half) - 1, F.lit(0))))).alias("window"))
    windows = windows.groupBy("doc_id", "window", "h", "classes").agg(F.min("pos").alias("pos"))  # classes go with h

    def minima(df, *keys):
        least = df.groupBy(*keys).agg(*[F.min(F.xxhash64("h", F.lit(b))).alias(f"m{b}") for b in range(bands)])
        return least.select(*keys, F.posexplode(F.array(*[f"m{b}" for b in range(bands)])).alias("band", "least"))

    pieces = windows.select("doc_id", "window", "h", "pos", F.explode("classes").alias("cls")).withColumn("piece", F.expr("shiftright(pos, cls)"))
    found = (minima(pieces, "doc_id", "window", "cls", "piece").join(minima(known, "template_id", "cls"), ["cls", "band", "least"])
             .select("doc_id", "window", "template_id").distinct())
    matched = (windows.join(found, ["doc_id", "window"]).join(known.select("template_id", "h"), ["template_id", "h"])
               .groupBy("doc_id", "window", "template_id").agg(F.count("*").alias("n_matched"), F.min("pos").alias("first_pos"))
               .join(sizes, "template_id").where(F.col("n_matched") * 100 >= F.col("n_template") * percent))
    best = (matched.groupBy("doc_id", "template_id", "n_template")
            .agg(F.max(F.struct("n_matched", (-F.col("first_pos")).alias("at"))).alias("top")))
    return best.join(named, "template_id").select(
        "doc_id", "template_id", "license", F.col("top.n_matched").alias("n_matched"), "n_template",
        (F.col("top.n_matched") / F.col("n_template")).alias("containment"), (-F.col("top.at")).cast("long").alias("first_pos"))
