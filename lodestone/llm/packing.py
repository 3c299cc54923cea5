"""Packing documents into training sequences by vector best fit.

A document is its token ids and an end id; longer ones are cut into pieces of a sequence's capacity.  Every sequence has
three capacities: tokens, pieces, and attention cost (a piece of n tokens costs n squared, as attention stays within a
piece).  A task packs its pieces in blocks of a few thousand; in a block the largest piece comes first and goes to the open
sequence that has room for it under every constraint and for which the rest after placing it has the smallest weighted norm
(``norm``), or the product of piece and rest is the smallest (``dot``); where none has room, a new sequence opens.

Sequences are written by the task that makes the tokens, so tokens are neither shuffled nor written twice.  What a block
leaves poorly filled, its last sequences as a rule, is taken apart and packed again with what other blocks left: these
pieces alone are shuffled.  The rows that they came from stay in their files, marked ``again``, and readers skip them.
Results are read back from the sequences.

Encoding is the tokenizers library's.  Its pattern drops white space, so distinct chunks between white space are encoded
once for a slice of texts; letters of the Latin blocks with marks behind them go straight to its model, all other chunks
through the library as they are.

Defined cases: null and empty texts have the end id only; rows that repeat a doc_id, or are equal, are documents of their
own; the string of a special token gives its id, as the library does by default; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, text_slices
from .tokens import BLOCK as CALL
from .tokens import CACHE_BYTES, END_ID, ChunkEncoder, _gather, tokenizer_path

PIECES_A_BLOCK = 4096
#: Sequences in a batch that a task hands over.
SEQUENCES_A_BATCH = 256
#: Letters that are one code point in every normal form, and marks that make up one piece of the tokenizer's pattern (the apostrophe begins contractions).
_SIMPLE = r"^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
_SEQUENCES = "sequence_id long, ids array<int>, pieces array<struct<doc_id:long,piece:int,start:long,offset:long,length:int>>, again boolean"
#: A sequence filled less than this is packed again.
FILLED = 0.95


class WordEncoder(ChunkEncoder):
    """Arrow texts to flat ids, for a tokenizer that lower-cases and drops white space; words end in a mark of their own."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._lines = Tokenizer(self._tokenizer.model)
        self._lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")  # takes pieces as the model shows them, a line each
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(33, 256)) if c.isprintable()]
        self._shown = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        suffix = self._tokenizer.model.end_of_word_suffix
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), dtype=bool)
        self._ends[[i for token, i in self._tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._limit = cache_bytes
        self._forget()

    def _words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces of the pattern."""
        flat, counts = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)]
        for at in range(0, len(pieces), CALL):
            joined = "\n".join(pieces.slice(at, CALL).to_pylist())
            if not joined.isascii():
                joined = joined.translate(self._shown)
            ids = np.array(self._lines.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
            flat.append(ids)
            counts.append(np.diff(np.r_[-1, np.flatnonzero(self._ends[ids])]))
        return np.concatenate(flat), np.concatenate(counts)

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, starts and sizes of the ids of chunks without white space."""
        form = pc.extract_regex(chunks, _SIMPLE)
        simple = np.asarray(form.is_valid())
        word, marks = (form.field(i).filter(pa.array(simple)) for i in range(2))
        tables, slots, count = [(np.array([], dtype=np.int32), np.zeros(1, dtype=np.int64))], np.zeros((len(word), 2), dtype=np.int64), 1  # piece 0: nothing
        for column, which, pieces in ((0, np.ones(len(word), dtype=bool), pc.utf8_lower(word)), (1, np.asarray(pc.not_equal(marks, "")), marks)):
            coded = pieces.filter(pa.array(which)).dictionary_encode()
            slots[which, column] = count + coded.indices.to_numpy()
            count += len(coded.dictionary)
            tables.append(self._words(coded.dictionary))
        values, sizes = (np.concatenate([t[i] for t in tables]) for i in range(2))
        starts = np.cumsum(sizes) - sizes
        more, more_sizes = self._as_table(self._raw(chunks.filter(pa.array(~simple)).to_pylist()))
        flat = np.concatenate([_gather(values, starts[slots.ravel()], sizes[slots.ravel()]), more])
        order = np.r_[np.flatnonzero(simple), np.flatnonzero(~simple)]
        own = np.r_[sizes[slots].sum(axis=1), more_sizes]
        out_starts, out_sizes = np.empty(len(chunks), dtype=np.int64), np.empty(len(chunks), dtype=np.int64)
        out_starts[order], out_sizes[order] = np.cumsum(own) - own, own
        return flat, out_starts, out_sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        coded = chunks.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        where = pc.index_in(distinct, value_set=self._known)
        fresh = np.asarray(where.is_null())
        learned = self._learn(distinct.filter(pa.array(fresh)))
        values = np.concatenate([self._values, learned[0]])
        starts, sizes = np.r_[self._starts, learned[1] + len(self._values)], np.r_[self._sizes, learned[2]]
        place = pc.fill_null(where, 0).to_numpy().astype(np.int64)
        place[fresh] = len(self._known) + np.arange(len(learned[1]))
        at = place[which]
        ids = _gather(values, starts[at], sizes[at])
        until = np.r_[0, np.cumsum(sizes[at])]
        lengths = np.diff(until[ends - ends[0]])
        self._keep(distinct, place, fresh, values, starts, sizes)
        return ids, lengths

    def _keep(self, distinct: pa.Array, place: np.ndarray, fresh: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Add the new chunks, as long as there is room."""
        new = distinct.filter(pa.array(fresh))
        if self._known.nbytes + new.nbytes + self._values.nbytes + 4 * sizes[place[fresh]].sum() + 16 * (len(self._known) + len(new)) <= self._limit:
            at = np.r_[np.arange(len(self._known)), place[fresh]]
            self._known, self._values, self._sizes = pa.concat_arrays([self._known, new]), _gather(values, starts[at], sizes[at]), sizes[at]
            self._starts = np.cumsum(self._sizes) - self._sizes


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most.  By default only tokens bind: pieces have a token at least, and squares of lengths sum up to the square of their sum at most."""

    tokens: int = 2048
    pieces: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def best_fit(lengths: Sequence[int], limits: Capacity) -> np.ndarray:
    """The sequence (0, 1, ...) of each piece; pieces come in the order given, largest first for good results."""
    sizes = np.asarray(lengths, dtype=np.float64)
    caps = np.array([limits.tokens, limits.pieces, limits.attention], dtype=np.float64)
    assert limits.rule in ("norm", "dot") and (not len(sizes) or (sizes.max() <= caps[0] and (sizes**2).max() <= caps[2] and caps[1] >= 1)), "a piece is larger than a sequence"
    weights = np.array(limits.weights)[:, None]
    least = np.minimum.accumulate(sizes[::-1])[::-1] if len(sizes) else sizes
    rest, names, made = np.empty((3, 64)), np.empty(64, dtype=np.int64), 0
    opened, out = 0, np.empty(len(sizes), dtype=np.int64)
    for i, size in enumerate(sizes):
        need = np.array([[size], [1.0], [size * size]])
        left = rest[:, :opened] - need
        fits = np.flatnonzero((left >= 0).all(axis=0))
        if len(fits):
            share = left[:, fits] / caps[:, None]
            score = (weights * share * (share if limits.rule == "norm" else need / caps[:, None])).sum(axis=0)
            at = fits[np.argmin(score)]
        else:
            if opened == len(names):
                rest, names = np.concatenate([rest, np.empty_like(rest)], axis=1), np.concatenate([names, np.empty_like(names)])
            at, opened, made = opened, opened + 1, made + 1
            rest[:, at], names[at] = caps, made - 1
        rest[:, at] -= need[:, 0]
        out[i] = names[at]
        least_now = least[i + 1] if i + 1 < len(sizes) else np.inf
        if rest[0, at] < least_now or rest[1, at] < 1 or rest[2, at] < least_now * least_now:  # nothing that is to come has room
            opened -= 1
            rest[:, at], names[at] = rest[:, opened], names[opened]
    return out


@dataclass
class Pieces:
    """Columns of pieces, and their ids one after the other."""

    doc_id: pa.Array
    piece: np.ndarray
    start: np.ndarray
    length: np.ndarray
    ids: np.ndarray

    def take(self, at: np.ndarray) -> Pieces:
        starts = np.cumsum(self.length) - self.length
        return Pieces(self.doc_id.take(pa.array(at)), self.piece[at], self.start[at], self.length[at], _gather(self.ids, starts[at], self.length[at]))

    @staticmethod
    def join(parts: Sequence[Pieces]) -> Pieces:
        whole = [np.concatenate([getattr(p, c) for p in parts]) for c in ("piece", "start", "length", "ids")]
        return Pieces(pa.concat_arrays([p.doc_id for p in parts]), *whole)


def _cut(encoder: WordEncoder, batch: pa.RecordBatch, end_id: int, longest: int) -> Pieces:
    """doc_id and text to pieces of at most ``longest`` ids."""
    flat, sizes = encoder.encode(batch.column(1))
    values = np.insert(flat, np.cumsum(sizes), end_id)
    sizes = sizes + 1
    pieces = -(-sizes // longest)
    row = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return Pieces(batch.column(0).take(pa.array(row)), nth, nth * longest, np.minimum(sizes[row] - nth * longest, longest), values)


def _pack(own: Pieces, limits: Capacity, first_id: int, filled: float) -> Iterator[pa.RecordBatch]:
    """Sequences of a block of pieces, named from ``first_id`` on; those filled less than ``filled`` are to be packed again."""
    falling = np.argsort(-own.length, kind="stable")
    bins = best_fit(own.length[falling], limits)
    order = np.argsort(bins, kind="stable")
    bins, order = bins[order], falling[order]
    heads = np.r_[np.flatnonzero(np.diff(bins, prepend=-1)), len(bins)]
    for at in range(0, len(heads) - 1, SEQUENCES_A_BATCH):
        part = heads[at : at + SEQUENCES_A_BATCH + 1]
        yield _sequences(own.take(order[part[0] : part[-1]]), part - part[0], limits, first_id + at, filled)


def _sequences(own: Pieces, heads: np.ndarray, limits: Capacity, first_id: int, filled: float) -> pa.RecordBatch:
    """Rows of sequences; ``heads``: where each one's pieces begin, and the end."""
    before = np.r_[0, np.cumsum(own.length)]
    offset = before[:-1] - np.repeat(before[heads[:-1]], np.diff(heads))
    columns = [own.doc_id, pa.array(own.piece, pa.int32()), pa.array(own.start, pa.int64()), pa.array(offset, pa.int64()), pa.array(own.length, pa.int32())]
    pieces = pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.StructArray.from_arrays(columns, ["doc_id", "piece", "start", "offset", "length"]))
    ids = pa.ListArray.from_arrays(pa.array(before[heads], pa.int32()), pa.array(own.ids, pa.int32()))
    names = pa.array(first_id + np.arange(len(heads) - 1), pa.int64())
    cost = np.diff(np.r_[0, np.cumsum(own.length.astype(np.int64) ** 2)][heads])
    use = np.maximum.reduce([np.diff(before[heads]) / limits.tokens, np.diff(heads) / limits.pieces, cost / limits.attention])  # of the scarcest capacity
    return pa.RecordBatch.from_arrays([names, ids, pieces, pa.array(use < filled)], ["sequence_id", "ids", "pieces", "again"])


#: A worker's encoders, kept between the tasks that it runs; each holds CACHE_BYTES at most.
_encoders: dict[str, WordEncoder] = {}


def _pack_partition(path: str, end_id: int, longest: int, limits: Capacity, most: int):
    """Texts to sequences, a block of ``most`` pieces at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        task, made, waiting, count = TaskContext.get(), 0, [], 0
        for batch in batches:
            for part in text_slices(batch, 1):
                waiting.append(_cut(encoder, part, end_id, longest))
                count += len(waiting[-1].length)
                while count >= most:
                    whole = Pieces.join(waiting)
                    block, waiting, count = whole.take(np.arange(most)), [whole.take(np.arange(most, count))], count - most
                    del whole
                    yield from _pack(block, limits, (task.partitionId() << 32) + made, FILLED)
                    made += most  # more names than a block has sequences
        if count:
            yield from _pack(Pieces.join(waiting), limits, (task.partitionId() << 32) + made, FILLED)

    return run


def _pack_group(limits: Capacity):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("sequence_id", "ascending")])
        flat = group["ids"].combine_chunks().flatten().to_numpy()
        own = Pieces(group["doc_id"].combine_chunks(), *(group[c].to_numpy() for c in ("piece", "start", "length")), flat)
        return pa.Table.from_batches(_pack(own, limits, (1 << 62) + (group["block"][0].as_py() << 24), 0))

    return run


def pack_sequences(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, limits: Capacity | None = None, pieces_a_block: int = PIECES_A_BLOCK) -> None:
    """Write sequence_id, ids, and pieces (doc_id, piece, start, offset, length) of the sequences that hold all of ``docs``."""
    spark, limits = docs.sparkSession, limits or Capacity()
    longest = min(limits.tokens, math.isqrt(limits.attention))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(_pack_partition(path or tokenizer_path("word_bpe_49k.json"), end_id, longest, limits, pieces_a_block), _SEQUENCES)
    packed.write.option("compression", "zstd").parquet(f"{folder}/round=0")
    loose = spark.read.schema(_SEQUENCES).parquet(f"{folder}/round=0").where("again")
    count = loose.agg(F.sum(F.size("pieces"))).first()[0]
    if count:
        each = loose.select("sequence_id", "ids", F.explode("pieces").alias("p"))
        each = each.select("sequence_id", "p.*", F.slice("ids", F.col("p.offset").cast("int") + 1, F.col("p.length")).alias("ids"))
        block = F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(math.ceil(count / pieces_a_block)))
        repacked = each.withColumn("block", block).groupBy("block").applyInArrow(_pack_group(limits), _SEQUENCES)
        repacked.write.option("compression", "zstd").parquet(f"{folder}/round=1")


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The sequences that pack_sequences() wrote, less those that it packed again."""
    return spark.read.schema(f"{_SEQUENCES}, round int").parquet(folder).where(~F.col("again")).drop("again", "round")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, pieces = batch.column(1), batch.column(2)
        flat, starts = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()[:-1].astype(np.int64)
        own = pieces.flatten()
        row = np.repeat(np.arange(len(batch)), np.diff(pieces.offsets.to_numpy()))
        at, size = starts[row] + own.field("offset").to_numpy(), own.field("length").to_numpy()
        sums = [zlib.crc32(flat[a : a + n].tobytes()) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
        columns = [own.field("doc_id"), own.field("piece"), own.field("start"), pa.array(size, pa.int64()), pa.array(sums, pa.int64()), batch.column(0).take(pa.array(row)), own.field("offset")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, from the sequences written."""
    return read_sequences(spark, folder).mapInArrow(_digests, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "sequences")
    pack_sequences(table(spark, sf_dir, "documents"), folder)
    return read_pieces(spark, folder)
