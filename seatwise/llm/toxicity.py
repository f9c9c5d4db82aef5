"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is embedded as the sum of the rows its hash and the hashes of its first 4, 5 and 6 bytes
select. Filters of several widths run over the word sequence, a rectifier and the maximum over
the whole text follow, and two linear heads read the maxima: one for toxicity, one that guesses
the language from the text alone. The threshold of the toxicity head is calibrated by guessed
language, and the score is the logistic of the distance to it, so 0.5 is the decision.

The model is fitted on the driver on a bounded sample (``Sample``) and broadcast; its size depends
on the parameters only. Scoring folds embeddings and filters into one table of products, so that
a word costs four row gathers.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.llm import words as W
from seatwise.llm.memory import frugal

PREFIXES = (None, 4, 5, 6)


@dataclasses.dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: texts of each label, and characters of a text in it."""

    per_label: int = 4000
    max_chars: int = 20_000


@dataclasses.dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 15
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8


def word_ids(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (words x 4) and where each text's words begin."""
    found = W.Words(data, offsets, W.letter_words())
    ids = [(found.hashes(p) % np.uint64(buckets)).astype(np.int32) for p in PREFIXES]
    return np.stack(ids, 1).reshape(-1, len(PREFIXES)), found.first


class ConvNet:
    """Widths x filters maxima -> toxicity logit and language logits."""

    def __init__(self, shape: Shape, languages: list[str], seed: int = 17):
        rng = np.random.default_rng(seed)
        self.shape, self.languages = shape, languages
        self.pad = max(shape.widths) - 1
        f, total = shape.filters, shape.filters * len(shape.widths)
        self.embed = rng.normal(0, 0.3, (shape.buckets + 1, shape.dim)).astype(np.float32)
        self.embed[-1] = 0  # the pad
        self.conv = [rng.normal(0, (1 / (w * shape.dim)) ** 0.5, (w, shape.dim, f)).astype(np.float32) for w in shape.widths]
        self.bias = np.zeros(total, np.float32)
        self.head = rng.normal(0, 0.1, (total, 1 + len(languages))).astype(np.float32)
        self.head_bias = np.zeros(1 + len(languages), np.float32)
        self.thresholds = np.zeros(max(1, len(languages)), np.float32)

    def _begin(self, ids, first, toxic, weight, language):
        """Start embedding rows at shrunken log odds, so that the maxima find telling words at once.

        Column 0 holds the log odds of toxicity of the texts in which the row occurs, column 1 + k
        those of language k; the first filters of each width read these columns.
        """
        b, n = self.shape.buckets, len(first) - 1
        targets = ([toxic == 1] + [language == k for k in range(len(self.languages))])[:self.shape.dim]
        weights = [weight] + [np.where(t, 0.5 / max(1, t.sum()), 0.5 / max(1, n - t.sum())) * n for t in targets[1:]]
        yes, no = np.zeros((2, len(targets), b + 1))
        for d in range(n):  # sums by text, so that memory follows one text and not the sample
            rows = np.unique(ids[first[d]:first[d + 1]])
            for k, target in enumerate(targets):
                (yes if target[d] else no)[k, rows] += weights[k][d]
        self.embed *= 0.2
        for k in range(len(targets)):
            self.embed[:, k] = np.log((yes[k] + 10) / (no[k] + 10)) / len(PREFIXES)
        self.embed[-1] = 0
        for c in self.conv:
            c *= 0.3
            for k in range(min(len(targets), self.shape.filters, self.shape.dim)):
                c[0, :, k] = 0
                c[0, k, k] = 1

    def _padded(self, ids, first):
        """Rows with ``pad`` empty words before and after each text; the positions of text d are at[d]:at[d + 1]."""
        counts = np.diff(first)
        at = np.concatenate([[0], np.cumsum(counts + self.pad)])
        rows = np.full((at[-1] + self.pad, ids.shape[1]), self.shape.buckets, np.int32)
        rows[np.arange(len(ids)) + np.repeat(at[:-1] - first[:-1] + self.pad, counts)] = ids
        return rows, at

    def _maxima(self, z, at):
        """Largest value and its position of each column in each text (a text has ``pad`` positions at least)."""
        top = np.maximum.reduceat(z, at[:-1], axis=0)
        hit = z == np.repeat(top, np.diff(at), axis=0)
        where = np.maximum.reduceat(np.where(hit, np.arange(len(z), dtype=np.int32)[:, None], np.int32(-1)), at[:-1], axis=0)
        return top, where

    def fit(self, texts, toxic: np.ndarray, language: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.05) -> None:
        """texts: (ids, first) of all texts; language: index or -1. Adagrad on touched rows only."""
        rng = np.random.default_rng(5)
        ids, first = texts
        n = len(first) - 1
        weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, n - toxic.sum())) * n
        self._begin(ids, first, toxic, weight, language)
        seen = [np.full_like(x, 1e-3) for x in (self.embed, *self.conv, self.bias, self.head, self.head_bias)]
        held = rng.random(n) < 0.2  # for the thresholds
        train = np.flatnonzero(~held) if (~held).any() else np.arange(n)

        def step(x, s, grad, rows=slice(None)):
            s[rows] += grad * grad
            x[rows] -= rate * grad / np.sqrt(s[rows])

        f = self.shape.filters
        for _ in range(epochs):
            rng.shuffle(train)
            for lo in range(0, len(train), batch):
                pick = train[lo:lo + batch]
                own = np.concatenate([ids[first[d]:first[d + 1]] for d in pick])
                begin = np.concatenate([[0], np.cumsum(first[pick + 1] - first[pick])])
                rows, at = self._padded(own, begin)
                x = self.embed[rows].sum(1)
                length = at[-1]
                z = np.concatenate([sum(x[o:o + length] @ c[o] for o in range(len(c))) for c in self.conv], 1)
                top, where = self._maxima(z, at)
                act = np.maximum(top + self.bias, 0)
                out = act @ self.head + self.head_bias
                p = 1 / (1 + np.exp(-np.clip(out[:, 0], -30, 30)))
                grad = np.zeros_like(out)
                grad[:, 0] = (p - toxic[pick]) * weight[pick]
                if len(self.languages):
                    e = np.exp(out[:, 1:] - out[:, 1:].max(1, keepdims=True))
                    e /= e.sum(1, keepdims=True)
                    known = language[pick] >= 0
                    e[np.flatnonzero(known), language[pick][known]] -= 1
                    grad[:, 1:] = e * known[:, None] * 0.3
                grad /= len(pick)
                back = (grad @ self.head.T) * (act > 0)
                step(self.head, seen[-2], act.T @ grad)
                step(self.head_bias, seen[-1], grad.sum(0))
                step(self.bias, seen[-3], back.sum(0))
                dx = np.zeros_like(x)
                for k, c in enumerate(self.conv):
                    g, pos = back[:, k * f:(k + 1) * f], where[:, k * f:(k + 1) * f]
                    dc = np.zeros_like(c)
                    for o in range(len(c)):
                        np.add.at(dx, pos + o, g[:, :, None] * c[o].T[None])
                        dc[o] = np.einsum("bfd,bf->df", x[pos + o], g)
                    step(c, seen[1 + k], dc)
                moved = np.flatnonzero(np.abs(dx).sum(1))
                if len(moved):
                    used, inverse = np.unique(rows[moved], return_inverse=True)
                    de = np.zeros((len(used), x.shape[1]), np.float32)
                    np.add.at(de, inverse.reshape(len(moved), -1), dx[moved][:, None])
                    step(self.embed, seen[0], de, used)
                    self.embed[-1] = 0
        logit, guess = self.logits(ids, first)
        for k in range(len(self.thresholds)):
            mine = held & (guess == k)
            self.thresholds[k] = _threshold(logit[mine], toxic[mine], weight[mine])

    def tables(self):
        """Products of every embedding row with every filter position, one block of columns each."""
        return np.concatenate([self.embed @ c[o] for c in self.conv for o in range(len(c))], 1)

    def logits(self, ids, first, table=None, limit: int = 1 << 16):
        """Toxicity logit and guessed language of each text; works on texts of up to ``limit`` words at a time."""
        table = self.tables() if table is None else table
        f, n = self.shape.filters, len(first) - 1
        logit, guess = np.zeros(n, np.float32), np.zeros(n, np.int64)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + limit, side="right")) - 1)
            rows, at = self._padded(ids[first[lo]:first[hi]], first[lo:hi + 1] - first[lo])
            y = table[rows[:, 0]]
            for c in range(1, rows.shape[1]):
                y += table[rows[:, c]]
            length, col, top = at[-1], 0, []
            for w in self.shape.widths:
                z = y[:length, col:col + f].copy()
                for o in range(1, w):
                    z += y[o:o + length, col + o * f:col + (o + 1) * f]
                col += w * f
                top.append(np.maximum.reduceat(z, at[:-1], axis=0))
            out = np.maximum(np.concatenate(top, 1) + self.bias, 0) @ self.head + self.head_bias
            logit[lo:hi] = out[:, 0]
            if len(self.languages):
                guess[lo:hi] = out[:, 1:].argmax(1)
            lo = hi
        return logit, guess


def _threshold(logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the least weighted error; 0 where one label is missing. Ties: the middle of the widest gap."""
    if not len(logit) or toxic.min() == toxic.max():
        return 0.0
    order = np.argsort(logit)
    x, w, t = logit[order], weight[order], toxic[order]
    error = np.concatenate([[0], np.cumsum(np.where(t == 1, w, -w))])
    cuts = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    gap = np.concatenate([[0], np.diff(x), [0]])
    best = np.flatnonzero(error <= error.min() + 1e-9)
    return float(cuts[best[gap[best].argmax()]])


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), shape: Shape = Shape()) -> ConvNet:  # noqa: B008
    """Fit on labelled documents whose crc32(doc_id as text) mod 5 is not 0, ``sample`` of them.

    Of each label the ``per_label`` texts of at most ``max_chars`` characters that come first by a
    hash of doc_id are read. Null labels and null texts are not learned from; a document with
    several label rows counts once for each label. Without labelled rows the model stays random
    with thresholds of 0.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    usable = (ids.where(F.length("text").between(1, sample.max_chars)).select("doc_id")
              .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).join(marked, "doc_id")
              .withColumn("turn", F.xxhash64("doc_id")))
    picked = None
    for label in (0, 1):  # bounded: per_label rows each
        one = usable.where(F.col("toxic") == label).orderBy("turn", "doc_id").limit(sample.per_label).select("doc_id", "toxic")
        picked = one if picked is None else picked.unionByName(one)
    local = docs.sparkSession.createDataFrame(picked.toPandas(), "doc_id long, toxic int")
    rows = (ids.where(F.length("text").between(1, sample.max_chars)).join(F.broadcast(local), "doc_id").toArrow()
            .sort_by([("doc_id", "ascending"), ("toxic", "ascending")]))
    toxic, spoken, texts = rows["toxic"].to_numpy(), rows["lang"].to_pylist(), rows["text"]
    del rows
    languages = sorted({x for x in spoken if x})
    net = ConvNet(shape, languages)
    if len(texts):
        parts, counts = [], []
        for _, _, data, offsets in W.blocks(texts, 1 << 17):
            got, first = word_ids(data, offsets, shape.buckets)
            parts.append(got)
            counts.append(np.diff(first))
        ids = np.concatenate(parts)
        first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        del texts, data, offsets, parts, got  # training reads the word ids alone
        where = {x: k for k, x in enumerate(languages)}
        net.fit((ids, first), toxic, np.array([where.get(x, -1) for x in spoken]))
    return net


def share(spark: SparkSession, net: ConvNet) -> Broadcast:
    """The net and its tables for ``score``; whoever shares it destroys it once the scores are written."""
    return spark.sparkContext.broadcast((net, net.tables()))


def score(docs: DataFrame, net: ConvNet | Broadcast, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_guess) of every row of ``docs``, and its columns ``carry``.

    Whole texts; null and empty texts, and texts without a word, get the score of the empty text.
    Only the text is read for the score, and it doesn't come back from the workers; a carried column may have
    any name but those of the result. Rows with a null doc_id are kept, with held_out null.
    """
    shared = net if isinstance(net, Broadcast) else share(docs.sparkSession, net)

    def run(batches):
        model, table = shared.value
        for batch in batches:
            logit, guess = np.zeros(batch.num_rows, np.float32), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in W.blocks(batch.column(1)):
                logit[lo:hi], guess[lo:hi] = model.logits(*word_ids(data, offsets, model.shape.buckets), table)
            p = 1 / (1 + np.exp(-np.clip(logit - model.thresholds[guess], -30, 30).astype(np.float64)))
            name = [model.languages[k] if model.languages else None for k in guess]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(name, pa.string())], ["row", "score", "lang_guess"])

    held = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0
    own = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in carry if c != "doc_id"]]
    rows = docs.select(F.struct(*own).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("lang_guess", T.StringType())])
    return (rows.mapInArrow(frugal(run), schema).select(
        "row.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_guess", *[f"row.{c}" for c in carry if c != "doc_id"]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    """Train on the labelled rows of ``docs`` and score all of them."""
    return score(docs, train(docs, labels, sample, shape))
