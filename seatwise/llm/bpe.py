"""BPE encoding and decoding with tree concatenation.

A text is a tree: it is halved, at any code point, down to leaves of at most ``TEXT_LEAF`` of them, and the leaves of all texts
of a block are encoded together. Neighbours are then joined, pair by pair: a window of text around the cut
is encoded anew, and grows until its first and last words agree with those of the two sides. A window begins
and ends at white space, which neither the normaliser nor the split rule nor a special token reaches across, or where its side
does, so that what the cut has torn apart (a word, a letter and its accent, a special token) lies inside it.

The words of the leaves are encoded once each and kept in a bounded cache. A word that is too long for that (letters
without a space) is a tree in its own right: its leaves are encoded in one parallel call, and at each join the
window is one of tokens, which grows until its first and last tokens agree. As every pair of neighbouring tokens
then stands in one true encoding, the joined tokens are those of the whole run.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.memory import frugal
from seatwise.llm.words import blocks

LEAF = 512  # letters of an unsplit run
TEXT_LEAF = 2048  # code points of a text
_CACHE = 150_000  # words; cleared when full

#: Texts of these characters alone are cut with the standard library; others by the tokenizer's own normaliser and pre-tokeniser.
_UNUSUAL = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-ɏ‐-‧€]")
#: The tokenizer's split rule for those characters.
_GAP = re.compile("[ \t\n\r]")
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\w\s]|_)+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}


_BYTE = _byte_letters()


def byte_level(word: str) -> str:
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTE)


class Coder:
    """Encoder for a tokenizer file with a word-end mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.mark = spec["model"].get("end_of_word_suffix") or ""
        self.closed = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.mark or None))
        self.open = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.joined = spec.get("decoder") is None  # tokens are then joined by a space, so words decode singly
        named = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.tokens = [named.get(i, "") for i in range(max(named, default=-1) + 1)]
        self.digits = [*map(str, range(len(self.tokens)))]
        #: The fast cut is the rule of this normaliser and pre-tokeniser only.
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and len(split) == 1 and split[0]["pattern"].get("Regex") == (
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        #: Without white space in special tokens, and with the known rule, texts may be cut anywhere.
        self.cuttable = self.plain and not any(re.search(r"\s", t) for t in self.special)
        self.joins = 0
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        """Words in byte-level letters or, of usual texts, as they are (with a leading mark that tells them apart)."""
        if self.plain and not _UNUSUAL.search(text):
            return _WORDS.findall(unicodedata.normalize("NFC", text).lower())
        shown = self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text
        return ["\0" + w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(shown)] if shown else []

    def _base(self, run: str, last: bool) -> list[tuple[int, int]]:
        """(id, length) of the tokens of a stretch; ``last``: its end is the end of the word."""
        e = (self.closed if last else self.open).encode(run, add_special_tokens=False)
        return self._sized(e, last)

    def _sized(self, e, last: bool) -> list[tuple[int, int]]:
        out = [(i, len(t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        if last and out and self.mark and e.tokens[-1].endswith(self.mark):
            out[-1] = (out[-1][0], out[-1][1] - len(self.mark))
        return out

    def tree(self, run: str, leaf: int = LEAF) -> list[int]:
        """Ids of an unsplit run, by halves joined in growing windows."""
        cuts = [0]
        while cuts[-1] < len(run):
            cuts.append(min(len(run), cuts[-1] + leaf))
        leaves = [run[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        level = [self._sized(e, False) for e in self.open.encode_batch(leaves[:-1], add_special_tokens=False)] + [self._base(leaves[-1], True)]
        begin = cuts[:-1]
        while len(level) > 1:
            pairs = range(0, len(level) - 1, 2)
            joined = [self._join(run, begin[k], level[k], level[k + 1]) for k in pairs]
            tail = level[len(pairs) * 2:]
            begin = [begin[k] for k in pairs] + begin[len(pairs) * 2:]
            level = joined + tail
        return [i for i, _ in level[0]]

    def _join(self, run: str, at: int, left: list, right: list) -> list:
        middle = at + sum(n for _, n in left)
        end = middle + sum(n for _, n in right)
        w = 4
        while True:
            x, y = left[-w:], right[:w]
            a, b = middle - sum(n for _, n in x), middle + sum(n for _, n in y)
            new = self._base(run[a:b], b == len(run))
            if (a == at or new[0] == x[0]) and (b == end or new[-1] == y[-1]) and (len(new) > 1 or (a == at and b == end)):
                return left[:-w] + new + right[w:]
            if a == at and b == end:
                return new
            w *= 2

    def learn(self, words) -> None:
        """Enter words into the cache that it lacks, all short ones in one call."""
        if len(self.ids) > _CACHE:
            self.ids.clear()
            self.text.clear()
        new = [w for w in words if w not in self.ids]
        shown = [w[1:] if w[0] == "\0" else byte_level(w) for w in new]
        short = [k for k, s in enumerate(shown) if len(s) <= LEAF]
        digits, tokens = self.digits, self.tokens
        for k, e in zip(short, self.closed.encode_batch([shown[k] for k in short], add_special_tokens=False), strict=True):
            ids = e.ids
            self.ids[new[k]] = " ".join([digits[i] for i in ids])
            self.text[new[k]] = " ".join([tokens[i] for i in ids])
        for k in {*range(len(new))}.difference(short):
            ids = self.tree(shown[k])
            self.ids[new[k]] = " ".join([digits[i] for i in ids])
            self.text[new[k]] = " ".join([tokens[i] for i in ids])

    def units(self, text: str) -> list[str]:
        """Words and special tokens of a stretch of text."""
        if not self.cut or not any(s in text for s in self.special):
            return self.words(text)
        return [w for k, p in enumerate(self.cut.split(text)) for w in (["\1" + p] if k % 2 else self.words(p))]

    def _same(self, x: str, y: str) -> bool:
        """Whether two units have the same tokens."""
        if x == y or x[0] == "\1" or y[0] == "\1":
            return x == y
        self.learn([x, y])
        return self.ids[x] == self.ids[y]

    def _join_text(self, text: str, start: int, middle: int, end: int, left: list[str], right: list[str]) -> list[str]:
        """Units of text[start:end] from those of text[start:middle] and text[middle:end]."""
        reach = 32
        self.joins += 1
        while True:
            a, b = max(start, middle - reach), min(end, middle + reach)
            if a > start:  # at white space, with a whole word between it and the cut's own
                gaps = [m.start() for m in _GAP.finditer(text, a, middle)]
                a = gaps[0] if len(gaps) > 1 and gaps[-1] - gaps[0] >= len(gaps) else None
            if b < end:
                gaps = [m.end() for m in _GAP.finditer(text, middle, b)]
                b = gaps[-1] if len(gaps) > 1 and gaps[-1] - gaps[0] >= len(gaps) else None
            if a is not None and b is not None:
                new, x, y = self.units(text[a:b]), len(self.units(text[a:middle])), len(self.units(text[middle:b]))
                if (a == start or self._same(new[0], left[len(left) - x])) and (b == end or self._same(new[-1], right[y - 1])):
                    return left[:len(left) - x] + new + right[y:]
            reach *= 2

    def tree_units(self, text: str, leaf: int = TEXT_LEAF) -> list[str]:
        """Units of a text by halves."""
        if len(text) <= leaf or not self.cuttable:
            return self.units(text)
        cuts = [0, len(text)]
        while cuts[1] > leaf:  # halves of halves
            cuts = [c for x, y in zip(cuts[:-1], cuts[1:], strict=True) for c in (x, (x + y) // 2)] + [len(text)]
        level = [self.units(text[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        while len(level) > 1:
            level = [self._join_text(text, *cuts[2 * k:2 * k + 3], level[2 * k], level[2 * k + 1]) for k in range(len(level) // 2)]
            cuts = cuts[::2]
        return level[0]

    def encode(self, texts: list[str], leaf: int = TEXT_LEAF) -> list[tuple[str, str]]:
        """(ids joined by a space, decoded text) of each text."""
        cut = [self.tree_units(text, leaf) for text in texts]
        self.learn([w for w in set().union(*cut) if w[0] != "\1"])
        for s, i in self.special.items():
            self.ids["\1" + s], self.text["\1" + s] = str(i), self.whole.decode([i], skip_special_tokens=False)
        ids = [" ".join(filter(None, map(self.ids.__getitem__, words))) for words in cut]
        if not self.joined:
            return [(x, self.whole.decode([*map(int, x.split())], skip_special_tokens=False)) for x in ids]
        return [(x, " ".join(filter(None, map(self.text.__getitem__, words)))) for x, words in zip(ids, cut, strict=True)]


@functools.lru_cache(maxsize=1)
def _coder(path: str) -> Coder:
    """One encoder for all tasks of a worker process, so that its cache is neither rebuilt nor held twice."""
    return Coder(path)


def encode_rows(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 20) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as decimal text joined by one space, and their decoded text.

    Null and empty texts have no ids and decode to the empty text; ties and repeated rows are
    encoded alike; other columns are ignored whatever their names; an empty table gives an empty
    result.
    """
    def run(batches):
        coder = _coder(tokenizer_path)
        for batch in batches:
            for lo, hi, _, _ in blocks(batch.column(1), block):  # few texts at a time are Python objects
                out = coder.encode([x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x for x, _ in out], pa.string()),
                                                  pa.array([y for _, y in out], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        frugal(run), "doc_id long, ids string, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, taken where the rows are encoded."""
    out = encode_rows(docs, tokenizer_path)
    return out.select("doc_id", F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
