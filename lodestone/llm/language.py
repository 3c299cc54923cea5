"""Language ID by interpolated Kneser-Ney character language models.

A model per language predicts each character from the three before it.  Its n-grams are hashed to 64-bit keys; one sorted
array of keys for each order holds those of all languages, beside a matrix with a column of log-probabilities (and of
back-off weights) for each, so a look-up serves all languages.  A text is scored whole: its cross-entropy is the mean
negative log-probability a character, the language with the lowest wins, ties going to the smaller name.

Rejection looks at the cross-entropy by pieces: each PIECE letters count under the language that predicts them best, so
a text in several known languages is no worse than its parts.  Calibration: a fifth of each language's sample, of a
single document its end, is not trained on (without a stretch in it, a language has the limits of all); stretches of it of each of LENGTHS give a median and a 90 % quantile by length, and a text above ``quantile + MARGIN *
(quantile - median)`` of its best language at its length (interpolated in the logarithm) is rejected; unless its words
without digits are at least a third of it and below the limit (a short text that holds a key).

Training reads a bounded sample: SAMPLE_DOCS documents and SAMPLE_CHARS characters a language at most, those of least
hash, of each its first DOC_CHARS characters, and TOTAL_CHARS characters of all languages: with many languages each has an
equal share, and with more than that has characters a language has one document of one character (its name is known, little
else).  The model's size is bounded by the sample's, so it is broadcast.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and counts as rejected; without any labelled
text everything is ``und``; every input row gives a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_slices

ORDER = 4
SAMPLE_DOCS, SAMPLE_CHARS, DOC_CHARS, TOTAL_CHARS = 400, 1_000_000, 50_000, 4_000_000
LENGTHS, STRETCHES, PIECE, MARGIN = (2, 4, 8, 16, 32, 64, 128, 256), 4000, 32, 6.0
SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32
_MIXED = re.compile(r"\w*\d\w*")
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def normalise(text: str | None) -> np.ndarray:
    """Code points: lower-cased letters, everything between them one space, after ORDER - 1 spaces; empty without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letter_table()[codes]
    if not letter.any():
        return np.empty(0, dtype=np.uint64)
    codes = np.where(letter, codes, _SPACE)
    codes = codes[letter | np.r_[True, letter[:-1]]]
    return np.r_[np.full(ORDER - 1, _SPACE), codes].astype(np.uint64)


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Key of the n-gram that ends at each position from ORDER - 1 on."""
    size = len(codes) - (ORDER - 1)
    key = np.full(size, n, dtype=np.uint64)
    for back in range(n - 1, -1, -1):
        at = ORDER - 1 - back
        key = (key ^ codes[at : at + size]) * _BASE
        key ^= key >> np.uint64(29)
    return key


def _prefix_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Key of the (n - 1)-gram before each position, as _keys would give it one position earlier."""
    size = len(codes) - (ORDER - 1)
    key = np.full(size, n - 1, dtype=np.uint64)
    for back in range(n - 1, 0, -1):
        at = ORDER - 1 - back
        key = (key ^ codes[at : at + size]) * _BASE
        key ^= key >> np.uint64(29)
    return key


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNey:
    """Sorted key arrays for orders 1 to ORDER with log2-probabilities and back-off weights of every language."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        per_language = [self._count([normalise(t) for t in samples[name]]) for name in self.languages]
        alphabet = np.unique(np.concatenate([x[1][0] for x in per_language])) if per_language else np.empty(0)
        self.floor = np.float32(-np.log2(len(alphabet) + 1))
        self.keys: list[np.ndarray] = [np.empty(0, dtype=np.uint64)]
        self.logp: list[np.ndarray] = [np.empty((0, len(per_language)), dtype=np.float32)]
        self.contexts: list[np.ndarray] = [np.empty(0, dtype=np.uint64)]  # of each order's n-grams, with the
        self.back: list[np.ndarray] = [np.empty((0, len(per_language)), dtype=np.float32)]  # weight of what follows unseen
        for n in range(1, ORDER + 1):
            self._add_order(n, per_language)
        self.limits: np.ndarray = np.full((len(self.languages), len(LENGTHS)), np.inf)

    @staticmethod
    def _count(texts: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: distinct keys, their (continuation) counts, their prefixes' and suffixes' keys."""
        texts = [t for t in texts if len(t)]
        out: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        counts: np.ndarray | None = None
        for n in range(ORDER, 0, -1):
            parts = [(_keys(t, n), _prefix_keys(t, n), _keys(t, n - 1)) for t in texts]
            keys, prefix, suffix = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, dtype=np.uint64) for i in range(3))
            distinct, first, raw = np.unique(keys, return_index=True, return_counts=True)
            if n < ORDER:  # continuation counts: in how many distinct longer n-grams each is the suffix
                ends, times = np.unique(out[n + 1][3], return_counts=True)
                at, there = _find(ends, distinct)
                raw = np.where(there, times[at] if len(times) else 0, 0)
            counts = raw.astype(np.float64)
            out[n] = (distinct, counts, prefix[first], suffix[first])
        return out

    def _add_order(self, n: int, per_language: list[dict]) -> None:
        tables = [x[n] for x in per_language]
        every = np.concatenate([t[0] for t in tables]) if tables else np.empty(0, dtype=np.uint64)
        keys, first = np.unique(every, return_index=True)
        prefix = np.concatenate([t[2] for t in tables])[first] if tables else every
        suffix = np.concatenate([t[3] for t in tables])[first] if tables else every
        lower = self._lookup(n - 1, suffix, None) if n > 1 else np.full((len(keys), len(tables)), self.floor, dtype=np.float32)
        logp = np.empty((len(keys), len(tables)), dtype=np.float32)
        contexts = np.unique(np.concatenate([t[2] for t in tables])) if tables else every
        back = np.zeros((len(contexts), len(tables)), dtype=np.float32)
        for column, (own, count, own_prefix, _) in enumerate(tables):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            names, of = np.unique(own_prefix, return_inverse=True)
            total = np.bincount(of, weights=count, minlength=len(names))
            kinds = np.bincount(of, weights=(count > 0).astype(float), minlength=len(names))
            weight = np.where(total > 0, np.maximum(discount * kinds, 1e-9) / np.maximum(total, 1e-9), 1.0)
            at, there = _find(contexts, names)
            back[at[there], column] = np.log2(weight[there])
            where, seen = _find(names, prefix)
            mixed = np.where(seen, weight[where] if len(weight) else 1.0, 1.0) * np.exp2(lower[:, column].astype(np.float64))
            mine, there = _find(own, keys)
            direct = np.where(there, np.maximum(count[mine] - discount, 0) if len(count) else 0, 0)
            logp[:, column] = np.log2(mixed + np.where(seen, direct / np.maximum(total[where], 1e-9) if len(total) else 0, 0))
        self.keys.append(keys)
        self.logp.append(logp)
        self.contexts.append(contexts)
        self.back.append(back)

    def _lookup(self, n: int, keys: np.ndarray, at: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """log2-probabilities of n-grams by key; ``at`` (codes, positions) finds shorter ones for those not in the table."""
        where, there = _find(self.keys[n], keys)
        out = self.logp[n][where] if len(self.keys[n]) else np.zeros((len(keys), len(self.languages)), dtype=np.float32)
        missing = np.flatnonzero(~there)
        if len(missing):
            if n == 1:
                out[missing] = self.floor + self.back[1][0]  # n == 1: an unseen character, after the one empty context
            else:
                codes, positions = at
                positions = positions[missing]
                out[missing] = self._back_off(n, codes, positions)
        return out

    def _back_off(self, n: int, codes: np.ndarray, positions: np.ndarray) -> np.ndarray:
        around = codes[positions[:, None] + np.arange(-(ORDER - 1), 1)[None, :]]
        prefix = self._hash(around[:, ORDER - n : ORDER - 1], n - 1)
        shorter = self._hash(around[:, ORDER - n + 1 :], n - 1)
        where, there = _find(self.contexts[n], prefix)
        weight = np.where(there[:, None], self.back[n][where] if len(self.contexts[n]) else np.float32(0), np.float32(0))
        return weight + self._lookup(n - 1, shorter, (codes, positions))

    @staticmethod
    def _hash(grams: np.ndarray, n: int) -> np.ndarray:
        key = np.full(len(grams), n, dtype=np.uint64)
        for i in range(grams.shape[1]):
            key = (key ^ grams[:, i]) * _BASE
            key ^= key >> np.uint64(29)
        return key

    def _found(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """log2-probabilities by position and language of one normalised text, SLICE positions at a time."""
        for a in range(ORDER - 1, len(codes), SLICE):
            part = codes[a - (ORDER - 1) : a + SLICE]
            yield self._lookup(ORDER, _keys(part, ORDER), (part, np.arange(ORDER - 1, len(part))))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Sums of log2-probabilities over the positions of one normalised text."""
        return self.both_sums(codes)[0]

    def both_sums(self, codes: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums over the positions of one normalised text: of each language, and of each piece's best language."""
        total, pieces = np.zeros(len(self.languages)), 0.0
        for found in self._found(codes):
            sums = np.add.reduceat(found, np.arange(0, len(found), PIECE), axis=0, dtype=np.float64)
            total += sums.sum(axis=0)
            pieces += sums.max(axis=1).sum()
        return total, pieces

    def _stretches(self, codes: np.ndarray, most: int) -> list[np.ndarray]:
        """For each of LENGTHS: cross-entropies by pieces of up to ``most`` stretches that start with a word."""
        until = np.concatenate([np.zeros((1, len(self.languages))), *self._found(codes)]).cumsum(axis=0, dtype=np.float64)
        words, size = np.flatnonzero(codes[ORDER - 2 : -1] == _SPACE), len(until) - 1
        out = []
        for n in LENGTHS:
            starts = words[words + n <= size]
            starts = starts[np.unique(np.linspace(0, len(starts) - 1, most).astype(int))] if len(starts) else starts
            ends = starts[:, None] + np.arange(0, n + 1, min(n, PIECE))
            out.append(-(until[ends[:, 1:]] - until[ends[:, :-1]]).max(axis=2).sum(axis=1) / n)
        return out

    def calibrate(self, held: dict[str, list[str]]) -> None:
        found: list[list[np.ndarray]] = []
        for name in self.languages:
            texts = [c for c in map(normalise, held.get(name, [])) if len(c)]
            each = [self._stretches(c, max(1, STRETCHES // len(texts))) for c in texts]
            found.append([np.concatenate([e[i] for e in each]) if each else np.empty(0) for i in range(len(LENGTHS))])
        pooled = self._limits([np.concatenate(x) for x in zip(*found)]) if found else self.limits
        for column, own in enumerate(found):
            self.limits[column] = self._limits(own) if len(own[0]) else pooled

    @staticmethod
    def _limits(values: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(LENGTHS), np.inf)
        for i, of_length in enumerate(values):
            if len(of_length):
                middle, high = np.quantile(of_length, (0.5, 0.9))
                out[i] = high + MARGIN * (high - middle)
            elif i:  # no stretch is that long
                out[i] = out[i - 1]
        return out

    def _above(self, language: int, pieces: float, n: int) -> bool:
        return bool(-pieces / n > np.interp(np.log2(n), np.log2(LENGTHS), self.limits[language]))

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score in 0 to 1, cross-entropy in bits a character, rejected."""
        names, score, bits, rejected = [], np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            codes = normalise(text) if self.languages else np.empty(0)
            if not len(codes):
                names.append("und")
                continue
            n = len(codes) - ORDER + 1
            sums, pieces = self.both_sums(codes)
            entropy = -sums / n
            best = int(entropy.argmin())
            names.append(self.languages[best])
            score[i] = 1 / np.exp2(-np.minimum((entropy - entropy[best]) * min(n, 200), 1000)).sum()
            bits[i] = entropy[best]
            rejected[i] = self._above(best, pieces, n)
            if rejected[i] and 3 * (m := len(rest := normalise(_MIXED.sub(" ", text))) - ORDER + 1) >= n:
                rejected[i] = self._above(best, self.both_sums(rest)[1], m)
        return names, score, bits, rejected


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame) -> KneserNey:
    """Fit on documents that are not held out; see the module's text for the sample's bounds."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    sizes = materialize(rows.select("lang", "doc_id").distinct().groupBy("lang").agg(F.count("*").alias("n")))
    most = max(1, min(SAMPLE_CHARS, TOTAL_CHARS // max(1, sizes.count())))
    cut = min(DOC_CHARS, most)
    # only places that can be among a language's first are ranked, so a common language doesn't meet in one task
    share = sizes.select(F.col("lang").alias("l"), ((1 << 32) * F.lit(4.0 * SAMPLE_DOCS) / F.col("n")).alias("most"))
    near = rows.select("doc_id", "lang", "text", place.alias("place")).join(F.broadcast(share), F.col("lang") == F.col("l")).where(F.col("place") <= F.col("most"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    each = near.groupBy("doc_id", "lang", "place").agg(F.max(F.least(F.char_length("text"), F.lit(cut))).alias("size"))
    first = each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_DOCS)
    chosen = first.withColumn("until", F.sum("size").over(order)).where((F.col("until") <= most) | (F.col("nth") == 1))
    chosen = materialize(chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct())
    sample = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l"))).groupBy("doc_id", "lang").agg(F.min(F.substring("text", 1, cut)).alias("text"))
    fit: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.lang, r.doc_id)):  # bounded by the sample
        if len(normalise(r.text)):
            fit.setdefault(r.lang, []).append(r.text)
    for name, texts in fit.items():
        if len(texts) > 1:
            out = range(min(4, len(texts) - 1), len(texts), 5)
            fit[name], held[name] = [t for i, t in enumerate(texts) if i not in out], [texts[i] for i in out]
        elif len(normalise(texts[0][: (cut := len(texts[0]) * 4 // 5)])):
            fit[name], held[name] = [texts[0][:cut]], [texts[0][cut:]]
    model = KneserNey(fit)
    model.calibrate(held)
    return model


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (a character) and rejected of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                names, score, bits, rejected = model.value.identify(part.column("text").to_pylist())
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "bits", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits double, rejected boolean")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without documents that have no letter or whose cross-entropy is above their language's limit."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rejected = model.value.identify(part.column("text").to_pylist())[3]
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
