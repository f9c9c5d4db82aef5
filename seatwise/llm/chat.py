"""Chat formatting with schema fingerprints, in DataFrame operations only.

Records come in many layouts: rows by turn, message lists under several names, prompt and answer,
instruction with input and output. The field paths that a record has, or a table's schema, are
hashed; the hash selects a declarative mapping to canonical turns (conv_id, turn, role, text).
Turns are then rendered with a template whose control strings cannot occur inside roles or texts:
a backslash is doubled there and ``<|`` becomes ``<\\|``, which is undone on reading.
"""

from __future__ import annotations

import dataclasses
import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclasses.dataclass(frozen=True)
class Layout:
    """Paths that a record has, and where its turns are: fields of a row, a list, or single fields by role."""

    name: str
    paths: tuple[str, ...]
    row: tuple[str, str, str] | None = None  # turn, role, text
    items: tuple[str, str, str] | None = None  # list, role, text
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, fields joined by a blank line

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


# fixed values: field names of public chat and instruction data sets
LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn"), row=("turn", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Layout("prompt and completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system, prompt and response", ("prompt", "response", "system"),
           fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction and output", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction, input and output", ("input", "instruction", "output"),
           fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)
# fixed values: other names of the three roles
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_KNOWN = sorted({p for x in LAYOUTS for p in x.paths})


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested leaf paths of a schema; list items are ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def _select(found: set[str]) -> Layout | None:
    """The layout whose fingerprint the known paths of a record hash to."""
    mark = fingerprint(found & set(_KNOWN))
    return next((x for x in LAYOUTS if x.fingerprint == mark), None)


def _turns(layout: Layout, of) -> Column:
    """Turns of a record as a list, by the layout's mapping; ``of`` gives a field's column."""
    if layout.items:
        name, role, text = layout.items
        return F.transform(of(name), lambda x, i: F.struct(i.cast("long").alias("turn"), x[role].alias("role"), x[text].alias("text")))
    return F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"),
                              F.array_join(F.filter(F.array(*[of(n) for n in names]), lambda x: x.isNotNull() & (x != "")), "\n\n").alias("text"))
                     for k, (role, names) in enumerate(layout.fields)])


def _present(path: str) -> Column:
    """Whether a parsed record has the path, in some list item where it leads through a list."""
    top, _, leaf = path.partition("[].")
    return F.exists(F.col(f"r.{top}"), lambda x: x[leaf].isNotNull()) if leaf else F.col(f"r.{top}").isNotNull()


def _canonical(df: DataFrame) -> DataFrame:
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    named = reduce(lambda c, x: c.when(role == x[0], x[1]), ROLES.items(), F.when(F.lit(False), "")).otherwise(F.coalesce("role", F.lit("")))
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), named.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def from_table(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns of a table in one layout, chosen by its schema's fingerprint; other columns are ignored."""
    layout = _select(set(schema_paths(df.schema)))
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(set(schema_paths(df.schema)) & set(_KNOWN))}")
    key = F.col(id_col).cast("long").alias("conv_id")
    if layout.row:
        turn, role, text = layout.row
        return _canonical(df.select(key, F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")))
    return _canonical(df.select(key, F.inline(_turns(layout, F.col))))


def from_json(df: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """Canonical turns of JSON records of mixed layouts, each chosen by the record's own fingerprint.

    A field that is absent or null isn't a path of the record. Records that are null, no JSON or of
    no known layout give no turns.
    """
    fields: dict[str, set[str]] = {}
    for p in _KNOWN:
        top, _, leaf = p.partition("[].")
        fields.setdefault(top, set()).update([leaf] if leaf else [])
    schema = T.StructType([T.StructField(k, T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in sorted(v)])) if v else T.StringType())
                           for k, v in sorted(fields.items())])
    has = [F.when(_present(p), F.lit(p)) for p in _KNOWN]
    rows = (df.select(F.col(id_col).cast("long").alias("conv_id"), F.from_json(F.col(json_col), schema).alias("r"))
            .withColumn("mark", F.sha2(F.concat_ws("\n", *has), 256)))
    pick = reduce(lambda c, x: c.when(F.col("mark") == x.fingerprint, _turns(x, lambda n: F.col(f"r.{n}"))), [x for x in LAYOUTS if not x.row], F.when(F.lit(False), F.lit(None)))
    return _canonical(rows.select("conv_id", F.inline(pick)))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): a conversation's text and the (start, length) in code points, from 0, of learned texts.

    Turns come in order of turn, ties by role and text, nulls first; repeated rows are turns of
    their own. Null roles and texts are empty; a line break in a role is escaped too. Turns with a
    null conv_id are one conversation. An empty table gives an empty result.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("<\\n"))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("conv_id", "turn", "role", "text", role.alias("r"), escape(F.col("text")).alias("x")).withColumn(
        "piece", F.concat(F.lit(START), "r", F.lit("\n"), "x", F.lit(END)))
    t = t.select(
        "conv_id", F.row_number().over(order).alias("n"), "piece",
        F.when(F.col("role") == learn, F.struct(
            (F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(START) + 1 + F.length("r")).cast("int").alias("start"),
            F.length("x").alias("length"))).alias("span"))
    return (t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("all"))
            .select("conv_id", F.array_join(F.col("all.piece"), "").alias("formatted"),
                    F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss")))


def read_turns(formatted: Column) -> Column:
    """The (role, text) list of a formatted conversation."""
    parts = F.filter(F.split(formatted, "<\\|im_end\\|>\n", -1), lambda p: p != "")

    def turn(p):
        body = F.substr(p, F.lit(len(START) + 1))
        at = F.instr(body, "\n")
        role = unescape(F.replace(F.substr(body, F.lit(1), at - 1), F.lit("<\\n"), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(F.substr(body, at + 1)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
