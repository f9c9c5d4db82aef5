"""Text column expressions used by ingest (all JVM-side, no Python UDFs).

Python semantics reproduced where they differ from SQL defaults: ``str.strip`` removes all
whitespace (``strip``), ``str.split()`` splits on whitespace runs and drops empties (``words``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seatwise.operators.util import strip

# Fixed values that must equal the original for the same results (listed in natural order).
GENDER_MALE = ["m", "male", "boy", "man"]
GENDER_FEMALE = ["f", "female", "girl", "woman"]
GENDER_OTHER = ["o", "other"]
MISSING_TOKENS = ["nan", "none", "null"]
# Cells that a roster reader takes as missing besides empty ones (case matters).
READER_MISSING = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                  "NULL", "NaN", "None", "n/a", "nan", "null"]


def normalise_header(c: Column) -> Column:
    """Lower, strip, ``[_-/:.]`` -> space, collapse whitespace (no re-strip afterwards)."""
    t = strip(F.lower(c))
    t = F.regexp_replace(t, r"[_\-/:.]", " ")
    return F.regexp_replace(t, r"\s+", " ")


def cell(c: Column) -> Column:
    """A roster cell as text: null where a reader takes it as missing."""
    t = c.cast("string")
    return F.when(t.isin(READER_MISSING), F.lit(None)).otherwise(t)


def words(c: Column) -> Column:
    """Python ``str.split()``: whitespace-separated tokens, no empties."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def token_sort(c: Column) -> Column:
    """Tokens sorted and joined by one space (the token-sort preprocessing)."""
    return F.array_join(F.array_sort(words(c)), " ")


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence length: bit-parallel when ``b`` fits in 62 bits, else DP."""
    return F.when(F.length(b) <= 62, lcs_bitparallel(a, b)).otherwise(lcs_dp(a, b))


def lcs_bitparallel(a: Column, b: Column) -> Column:
    """Bit-vector LCS (one machine word for ``b``, len(b) <= 62 so sums never overflow).

    ``V`` starts with len(b) one-bits; for each character c of ``a``: ``U = V & match(c)``,
    ``V = ((V + U) | (V - U)) & mask``. LCS = len(b) - popcount(V).
    """
    lb = F.length(b)
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, lb) - 1

    def match_bits(ca):
        return F.aggregate(F.sequence(F.lit(0), F.greatest(lb - 1, F.lit(0))), F.lit(0).cast("long"),
                           lambda acc, j: acc.bitwiseOR(
                               F.when((j < lb) & (F.substring(b, j + 1, 1) == ca),
                                      F.call_function("shiftleft", one, j)).otherwise(F.lit(0).cast("long"))))

    def step(v, ca):
        u = v.bitwiseAND(match_bits(ca))
        return (v + u).bitwiseOR(v - u).bitwiseAND(mask)

    v = F.aggregate(F.split(a, ""), mask, lambda v, ca: F.when(ca == "", v).otherwise(step(v, ca)))
    return (lb - F.bit_count(v)).cast("int")


def lcs_dp(a: Column, b: Column) -> Column:
    """Longest common subsequence length by dynamic programming in SQL higher-order functions.

    One DP row per character of ``a``; each row is built left to right over ``b``. Cost is
    O(len(a) * len(b)^2) per pair (array appends), so it only serves long strings.
    """
    lb = F.length(b)
    chars_a = F.split(a, "")
    init = F.array_repeat(F.lit(0), lb + 1)

    def step(prev, ca):
        def cell(cur, j):
            up = F.element_at(prev, j + 1)          # prev[j]
            left = F.element_at(cur, j)            # cur[j-1]
            diag = F.element_at(prev, j)           # prev[j-1]
            v = F.when(F.substring(b, j, 1) == ca, diag + 1).otherwise(F.greatest(up, left))
            return F.concat(cur, F.array(v))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(lb, F.lit(1))), F.array(F.lit(0)),
                           lambda cur, j: F.when(j <= lb, cell(cur, j)).otherwise(cur))

    last = F.aggregate(chars_a, init, lambda prev, ca: F.when(ca == "", prev).otherwise(step(prev, ca)))
    return F.coalesce(F.element_at(last, lb + 1), F.lit(0))


def indel_ratio(a: Column, b: Column) -> Column:
    """Normalised indel similarity 0-100: ``100 * 2 * LCS / (len(a) + len(b))``; 100 for two empties."""
    la, lb = F.length(a), F.length(b)
    return F.when((la + lb) == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) * (2 * lcs_length(a, b)) / (la + lb))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Indel ratio of the token-sorted strings (no other preprocessing)."""
    return indel_ratio(token_sort(a), token_sort(b))


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """Cheap bound: the indel ratio can never exceed ``200 * min(len) / (len sum)``."""
    la, lb = F.length(token_sort(a)), F.length(token_sort(b))
    return F.when((la + lb) == 0, F.lit(100.0)).otherwise(F.lit(200.0) * F.least(la, lb) / (la + lb))


def canon_gender(c: Column) -> Column:
    """Male / Female / Other / Unknown from free text (missing or blank -> Unknown)."""
    t = F.lower(strip(c))
    return (F.when(c.isNull() | (c == ""), "Unknown")
            .when(t.isin(GENDER_MALE), "Male")
            .when(t.isin(GENDER_FEMALE), "Female")
            .when(t.isin(GENDER_OTHER), "Other")
            .otherwise("Unknown"))


def is_missing_token(c: Column) -> Column:
    """C4: blank or a textual missing marker (nan / none / null, any case)."""
    return c.isNull() | (c == "") | F.lower(c).isin(MISSING_TOKENS)


def derive_code(name: Column, code: Column | None = None) -> Column:
    """Dimension code from a name (and an optional explicit code).

    ``upper(strip(code or name))[:20]``; without an explicit code, if that is longer than 4
    and the name contains a space: initials of the words (after deleting '&'), upper, [:10] --
    or, with fewer than two words, the first four characters of the name upper-cased.
    """
    clean = strip(name)
    given = strip(code) if code is not None else F.lit(None).cast("string")
    has_code = given.isNotNull() & (given != "")
    base = F.substring(F.upper(F.when(has_code, given).otherwise(clean)), 1, 20)
    w = words(F.regexp_replace(clean, "&", ""))
    initials = F.substring(F.upper(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")), 1, 10)
    by_words = F.when(F.size(w) >= 2, initials).otherwise(F.upper(F.substring(clean, 1, 4)))
    return F.when((F.length(base) > 4) & ~has_code & (F.instr(clean, " ") > 0), by_words).otherwise(base)


def _lcs_bits(a: str, b: str) -> int:
    """Bit-parallel LCS on Python ints (any length)."""
    if not a or not b:
        return 0
    masks: dict = {}
    for j, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for ch in a:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def _indel_ratio_series(a, b):
    import pandas as pd
    out = []
    for x, y in zip(a, b):
        x = "" if x is None else x
        y = "" if y is None else y
        n = len(x) + len(y)
        out.append(100.0 if n == 0 else 200.0 * _lcs_bits(x, y) / n)
    return pd.Series(out, dtype="float64")


def indel_ratio_vec(a: Column, b: Column) -> Column:
    """``indel_ratio`` as an Arrow-batched pandas UDF (same result; much cheaper per pair than
    interpreted higher-order functions). Used on distinct texts only."""
    from pyspark.sql.functions import pandas_udf
    udf = pandas_udf(_indel_ratio_series, "double")
    return udf(a, b)
