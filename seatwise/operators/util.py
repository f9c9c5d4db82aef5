"""Small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Row bound under which a counted, dimension-sized table (strata, strata x slots) is broadcast
# to the tasks holding member rows instead of meeting them in a shuffle join.
BROADCAST_ROW_LIMIT = 2_000_000


def all_of(preds: list[Column]) -> Column:
    """AND of predicates; TRUE when the list is empty."""
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


# The characters Python's str.strip() removes (str.isspace), in code-point order.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                 "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Python ``str.strip()``: remove all leading/trailing whitespace (Spark trim is spaces only).

    A character-set trim (no regex), so it stays cheap inside codegen."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Python truthiness for strings: '' counts as missing."""
    return F.when(c == "", F.lit(None)).otherwise(c)


def live(df: DataFrame) -> DataFrame:
    """Soft-delete predicate (D1): every read ignores deleted members."""
    return df.filter(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def local_frame(spark, rows: list[tuple], schema):
    """A small driver-side table as a DataFrame that plans as ``LocalTableScan``.

    Goes through pandas + Arrow, so no Python worker is needed to read it (a plain list would
    become a Python-backed RDD). Callers only pass tables whose size they have bounded.
    """
    import pandas as pd
    from pyspark.sql import types as T
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], schema)
    pdf = pd.DataFrame.from_records(rows, columns=schema.names).astype(object)
    return spark.createDataFrame(pdf, schema)


def ntz_lit(value) -> Column:
    """A naive ``datetime`` as a ``timestamp_ntz`` literal, independent of the session time zone
    (``F.lit(datetime)`` would be read as a zoned timestamp and shift on the cast)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
