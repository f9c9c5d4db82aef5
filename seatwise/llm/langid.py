"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text is built. Parsing a text greedily into the longest
phrases that occur in that language's text needs few phrases where the language is the same and
many where it is not; phrases are normalised by the size of the training text and by the length of
the parsed text (phrases * log2(n) / length estimates the cross entropy), and the least wins.

Each automaton is one transition table over a small learned alphabet, completed so that a missing
transition starts the next phrase and marks it. Texts are parsed in segments of ``SEGMENT``
characters, all segments of a block and all languages in step, so a character costs a few
vectorised operations; a phrase ends where its segment does. The tables depend on the sample's
bounds alone.
"""

from __future__ import annotations

import dataclasses
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.llm.memory import frugal
from seatwise.llm.words import blocks

SEGMENT = 1024
_LANES = 1 << 14
_POINTS = 0x110000
_FLAG = np.int32(1 << 30)


@dataclasses.dataclass(frozen=True)
class Sample:
    """Bounds of the labelled text of a language: texts, preferred length of one, characters of all."""

    texts: int = 60
    prefer_chars: int = 1000
    chars: int = 30_000
    alphabet: int = 63


def _lowered() -> np.ndarray:
    """Lower case of each code point where that is one code point, else itself."""
    low = np.arange(_POINTS, dtype=np.uint32)
    for c in range(0x3000):
        x = chr(c).lower()
        if len(x) == 1:
            low[c] = ord(x)
    return low


def _letters() -> np.ndarray:
    flags = np.zeros(_POINTS, bool)
    flags[[c for c in range(_POINTS) if chr(c).isalpha()]] = True
    return flags


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``symbols``: states x ``size``, -1 where there is none."""
    goto, link, longest = [[-1] * size], [-1], [0]
    last = 0
    for c in symbols:
        cur = len(goto)
        goto.append([-1] * size)
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and goto[p][c] < 0:
            goto[p][c] = cur
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if longest[p] + 1 == longest[q]:
                link[cur] = q
            else:
                clone = len(goto)
                goto.append(goto[q][:])
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and goto[p][c] == q:
                    goto[p][c] = clone
                    p = link[p]
        last = cur
    return np.array(goto, np.int32)


class Model:
    """Completed transition tables of all languages in one array, and the alphabet."""

    def __init__(self, texts: dict[str, str], alphabet: int):
        self.languages = sorted(texts)
        low = _lowered()
        letters = _letters()
        counts = Counter()
        for x in texts.values():
            own = low[points(x)]
            counts.update(own[letters[own]].tolist())
        self.symbol = np.zeros(_POINTS, np.uint8)  # 0: any other letter and every character that isn't a letter
        for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:alphabet]):
            self.symbol[low == c] = k + 1
        self.size = min(alphabet, len(counts)) + 1
        self.letters = letters
        tables, self.root, self.bits, base = [], [], [], 0
        for x in self.languages:
            symbols = self.symbol[points(texts[x])].tolist()
            goto = automaton(symbols, self.size)
            restart = np.where(goto[0] >= 0, goto[0] + base, base) * self.size | _FLAG  # an unknown symbol is a phrase of its own
            full = np.where(goto >= 0, (goto + base) * self.size, restart)
            full[0] = restart  # the first row begins a phrase with any symbol
            tables.append(full.astype(np.int32))
            self.root.append(base * self.size)
            self.bits.append(np.log2(len(symbols) + 2))
            base += len(goto)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns); codes are symbols of all texts."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.languages)))
        lengths = np.diff(offsets)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, offsets[owner + 1] - start)
        order = np.argsort(-size, kind="stable")
        padded = np.concatenate([codes, np.zeros(SEGMENT, codes.dtype)])
        for lo in range(0, len(order), _LANES):
            mine = order[lo:lo + _LANES]
            own = size[mine]
            state = np.repeat(np.array(self.root, np.int32)[:, None], len(mine), 1)
            count = np.zeros((len(self.languages), len(mine)), np.int32)
            active = np.searchsorted(-own, -np.arange(own[0]), side="left")
            for t in range(int(own[0])):
                k = active[t]
                c = padded[start[mine[:k]] + t].astype(np.int32)
                v = self.table.take(state[:, :k] + c)
                count[:, :k] += v >> 30
                state[:, :k] = v & (_FLAG - 1)
            for x in range(len(self.languages)):
                total[:, x] += np.bincount(owner[mine], count[x], n)
        return total

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of each text and 1 - its normalised phrases over the runner-up's; ``und`` and 0 without a letter."""
        raw = [points(x or "") for x in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        every = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
        spoken = np.concatenate([[0], np.cumsum(self.letters[every])])
        known = spoken[offsets[1:]] > spoken[offsets[:-1]]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = self.phrases(self.symbol[every], offsets) * np.array(self.bits)
        best = cost.argmin(1)  # ties: the first by name
        ranked = np.sort(cost, 1)
        margin = 1 - ranked[:, 0] / np.maximum(ranked[:, min(1, ranked.shape[1] - 1)], 1e-9) if ranked.shape[1] > 1 else np.ones(len(texts))
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(margin, 0, 1), 0.0)


def train(docs: DataFrame, sample: Sample = Sample()) -> Model:  # noqa: B008
    """Automata from rows with a language whose crc32(doc_id as text) mod 3 is not 1.

    Of each language the ``texts`` rows that come first are read, those of 100 to ``prefer_chars``
    characters before others and then by a hash of doc_id; of their joined text the first ``chars``
    characters are learned. Null and empty texts are not learned from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = rows.where("lang is not null and text <> ''").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    first = Window.partitionBy("lang").orderBy(F.expr(f"length not between 100 and {sample.prefer_chars}"), "turn", "doc_id")
    picked = (usable.select("doc_id", "lang", F.length("text").alias("length"), F.xxhash64("doc_id").alias("turn"))
              .withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample.texts).select("doc_id", "n"))
    chosen = docs.sparkSession.createDataFrame(picked.toPandas(), "doc_id long, n int")
    found = (usable.join(F.broadcast(chosen), "doc_id").select("lang", "n", F.substring("text", 1, sample.chars).alias("text")).toArrow().to_pandas()
             .sort_values(["lang", "n"]))
    return Model({lang: "\n".join(own["text"])[:sample.chars] for lang, own in found.groupby("lang")}, sample.alphabet)


def share(spark: SparkSession, model: Model) -> Broadcast:
    """The model for ``identify``; whoever shares it destroys it once the languages are written."""
    return spark.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: Model | Broadcast, carry: tuple[str, ...] = (), block: int = 1 << 20) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` and its columns ``carry``; whole texts, only they are read.

    Null and empty texts and those without a letter are ``und`` with score 0. Rows with a null
    doc_id are kept, with held_out null; other columns are ignored whatever their names. Texts don't come back
    from the workers; a carried column may have any name but those of the result.
    """
    shared = model if isinstance(model, Broadcast) else share(docs.sparkSession, model)

    def run(batches):
        net = shared.value
        for batch in batches:
            for lo, hi, _, _ in blocks(batch.column(1), block):
                names, score = net.classify(batch.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    held = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 3 == 1
    own = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in carry if c != "doc_id"]]
    rows = docs.select(F.struct(*own).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(frugal(run), schema).select("row.doc_id", held.alias("held_out"), "lang_pred", "score", *[f"row.{c}" for c in carry if c != "doc_id"])


def language_id(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:  # noqa: B008
    """Learn from the labelled rows of ``docs`` and identify all of them."""
    return identify(docs, train(docs, sample))
