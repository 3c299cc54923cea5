"""Token-ID output: Parquet list columns, delta-encoded, in ascending doc_id order, and reads of them.

Documents are dealt by ranges of doc_id and sorted, so each file covers a range and its row groups and page index serve
selective reads: ``doc_id`` and ``n_tokens`` can be read without ``ids``, and a range of doc_id skips pages.  Rows of a
doc_id that fills more than one range are dealt over all of them.

Encoding is the tokenizers library's.  A text without two white-space characters in a row, and without the string of a
special token, may be cut before any space or line feed: the tokenizer's own pattern never looks back and ends every piece
there.  So each distinct chunk of a slice of texts is encoded once, and a text's ids are its chunks' ids one after the
other, put together from flat arrays.  Chunks met twice are remembered, up to CACHE_BYTES a worker, packed in the same
form.  Other texts are encoded whole.

Defined cases: null and empty texts have the end id only; rows that repeat a doc_id are written one after the other, null
doc_ids first; an empty table gives no rows; the strings of special tokens give their ids, as the library does by default,
or with ``special_as_text`` are ordinary text.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table, text_slices

END_ID = 0
CACHE_BYTES = 24 << 20
SLICE_BYTES = 4 << 20
ROW_GROUP_BYTES = 32 << 20
#: White space of the tokenizer's pattern, and the controls that Python counts as such.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A line feed or nothing, letters, and ASCII marks that make up one piece of the tokenizer's pattern (the apostrophe begins contractions).
_SIMPLE = r"^(?P<line>\n?)(?P<word>\p{L}+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Pieces that go to the model in one call.
BLOCK = 500


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Arrow texts to flat ids.

    A run of letters is one piece of the tokenizer's pattern, so it goes straight to the tokenizer's model, with the space
    before it; so does the run of marks behind it.  Distinct pieces of
    a slice are encoded once.  Chunks of another form are encoded in full.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        self._lines = Tokenizer(self._tokenizer.model)
        self._lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")  # takes pieces as the model shows them, a line each
        self._model = self._tokenizer.model
        special = [] if special_as_text else [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._uncut = "|".join([_SPACE + "{2}", *(re.sub(r"([^\w\s])", r"\\\1", s) for s in special)])
        self._shown = {b: self._tokenizer.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        # how the model's alphabet shows bytes above 127: read off letters whose UTF-8 form has them
        self._shown |= self._high_bytes()
        self._shown_but_line = {b: c for b, c in self._shown.items() if b != 10}
        self._spaced = np.zeros(self._tokenizer.get_vocab_size(), dtype=bool)
        self._spaced[[i for token, i in self._tokenizer.get_vocab().items() if token[:1] == self._shown[32]]] = True
        self._limit = cache_bytes
        self._forget()

    def _forget(self) -> None:
        """Known chunks, without the space before them, and their ids as flat values with starts and sizes."""
        self._known, self._values = pa.array([], pa.string()), np.empty(0, dtype=np.int32)
        self._starts, self._sizes = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _high_bytes(self) -> dict[int, str]:
        """Byte -> character, from what the pre-tokenizer makes of every two- to four-byte lead and continuation."""
        out: dict[int, str] = {}
        for code in [*range(0x80, 0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x110000, 0x1000)]:
            raw = chr(code).encode()
            if any(b not in out for b in raw):
                shown = "".join(x for x, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(chr(code)))
                out.update(zip(raw, shown, strict=True))
        return out

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("i", x.ids).tobytes() for x in found]

    def _pieces(self, pieces: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of single pieces of the pattern, each after a space or none of them."""
        flat, counts = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)]
        for at in range(0, len(pieces), BLOCK):
            part = pieces.slice(at, BLOCK)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), "\n")[0].as_py()
            if not (joined.isascii() and spaced):
                joined = joined.encode().decode("latin-1").translate(self._shown_but_line)
            if not spaced:
                found = [[t.id for t in self._model.tokenize(x)] for x in joined.split("\n")]
                flat.append(np.fromiter((i for x in found for i in x), dtype=np.int32))
                counts.append(np.fromiter(map(len, found), dtype=np.int64))
                continue
            space = self._shown[32]
            ids = np.array(self._lines.encode_batch_fast([space + joined.replace("\n", "\n" + space)], add_special_tokens=False)[0].ids, dtype=np.int32)
            flat.append(ids)
            counts.append(np.diff(np.r_[np.flatnonzero(self._spaced[ids]), len(ids)]))
        return np.concatenate(flat), np.concatenate(counts)

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, starts and sizes of the ids of chunks, each after a space unless it begins with a line feed."""
        form = pc.extract_regex(chunks, _SIMPLE)
        simple = np.asarray(form.is_valid())
        line, word, marks = (form.field(i).filter(pa.array(simple)) for i in range(3))
        broken = np.asarray(pc.equal(line, "\n"))
        tables = [(np.array([], dtype=np.int32), np.zeros(1, dtype=np.int64)), self._as_table(self._raw(["\n"]))]  # piece 0: nothing; 1: a line feed
        slots = np.zeros((len(word), 3), dtype=np.int64)
        slots[:, 0] = broken
        count = 2
        for column, which, pieces, spaced in ((1, ~broken, word, True), (1, broken, word, False), (2, np.asarray(pc.not_equal(marks, "")), marks, False)):
            coded = pieces.filter(pa.array(which)).dictionary_encode()
            slots[which, column] = count + coded.indices.to_numpy()
            count += len(coded.dictionary)
            tables.append(self._pieces(coded.dictionary, spaced))
        values, sizes = (np.concatenate([t[i] for t in tables]) for i in range(2))
        starts = np.cumsum(sizes) - sizes
        rest = [c if c[:1] == "\n" else " " + c for c in chunks.filter(pa.array(~simple)).to_pylist()]
        more, more_sizes = self._as_table(self._raw(rest))
        flat = np.concatenate([_gather(values, starts[slots.ravel()], sizes[slots.ravel()]), more])
        order = np.r_[np.flatnonzero(simple), np.flatnonzero(~simple)]
        own = np.r_[sizes[slots].sum(axis=1), more_sizes]
        out_starts, out_sizes = np.empty(len(chunks), dtype=np.int64), np.empty(len(chunks), dtype=np.int64)
        out_starts[order], out_sizes[order] = np.cumsum(own) - own, own
        return flat, out_starts, out_sizes

    @staticmethod
    def _as_table(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(found), dtype=np.int32), np.fromiter((len(x) // 4 for x in found), dtype=np.int64, count=len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        n = len(texts)
        if not n:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        texts = pc.fill_null(texts, "")
        uncut = pc.match_substring_regex(texts, self._uncut)
        parts = pc.split_pattern(pc.replace_substring(pc.if_else(uncut, "", texts), "\n", " \n"), " ")
        chunks, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        heads = ends[:-1] - ends[0]
        first = self._raw(pc.if_else(uncut, texts, chunks.take(pa.array(heads))).to_pylist())
        inner = np.ones(len(chunks), dtype=bool)
        inner[heads] = False
        coded = chunks.filter(pa.array(inner)).dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        where = pc.index_in(distinct, value_set=self._known)
        fresh = np.asarray(where.is_null())
        learned = distinct.filter(pa.array(fresh))
        first_values, first_sizes = self._as_table(first)
        tables = [(self._values, self._starts, self._sizes), self._learn(learned), (first_values, np.cumsum(first_sizes) - first_sizes, first_sizes)]
        before = np.cumsum([0, *(len(t[0]) for t in tables)])
        values = np.concatenate([t[0] for t in tables])
        starts, sizes = np.concatenate([t[1] + b for t, b in zip(tables, before, strict=False)]), np.concatenate([t[2] for t in tables])
        place = pc.fill_null(where, 0).to_numpy().astype(np.int64)
        place[fresh] = len(self._known) + np.arange(len(learned))
        at = np.empty(len(chunks), dtype=np.int64)
        at[inner] = place[which]
        at[heads] = len(self._known) + len(learned) + np.arange(n)
        ids = _gather(values, starts[at], sizes[at])
        lengths = np.add.reduceat(sizes[at], heads)
        self._remember(distinct, place, np.bincount(which, minlength=len(distinct)), fresh, values, starts, sizes)
        return ids, lengths

    def _remember(self, distinct: pa.Array, place: np.ndarray, times: np.ndarray, fresh: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Add the chunks that came twice; beyond the limit only those of this slice stay, and if they are too many none."""
        again = times > 1
        new = distinct.filter(pa.array(again & fresh))
        if self._known.nbytes + new.nbytes + self._values.nbytes + 16 * (len(self._known) + len(new)) <= self._limit:
            keys, at = pa.concat_arrays([self._known, new]), np.r_[np.arange(len(self._known)), place[again & fresh]]
        else:
            keys, at = distinct.filter(pa.array(again)), place[again]
        kept = _gather(values, starts[at], sizes[at])
        if keys.nbytes + kept.nbytes + 16 * len(keys) > self._limit:
            self._forget()
        else:
            self._known, self._values, self._sizes = keys, kept, sizes[at]
            self._starts = np.cumsum(self._sizes) - self._sizes


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values at ``starts`` of ``sizes``, one after the other."""
    until = np.cumsum(sizes)
    total = int(until[-1]) if len(until) else 0
    number = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - (until - sizes)).astype(number), sizes)
    at += np.arange(total, dtype=number)
    return values[at]


#: A worker's encoders, kept between the tasks that it runs; each holds CACHE_BYTES at most.
_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def _encode(path: str, end_id: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (path, special_as_text)
        encoder = _encoders.get(name) or _encoders.setdefault(name, ChunkEncoder(path, special_as_text=special_as_text))
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                flat, sizes = encoder.encode(part.column(1))
                until = np.cumsum(sizes)
                values = np.insert(flat, until, end_id)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, until + np.arange(1, len(until) + 1)], pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes + 1, pa.int32()), ids], ["doc_id", "n_tokens", "ids"])

    return run


def _rank(sorted_values: list[int], strict: bool, key) -> object:
    """How many of the values are below ``key`` (or not above it): first among every STEP-th, then within one step."""
    step = max(1, int(len(sorted_values) ** 0.5))
    below = (lambda b: b < key) if strict else (lambda b: b <= key)
    every = F.array(*[F.lit(v).cast("long") for v in sorted_values])
    coarse = F.array(*[F.lit(v).cast("long") for v in sorted_values[step - 1 :: step]])
    done = F.size(F.filter(coarse, below)) * step
    return done + F.size(F.filter(F.slice(every, done + 1, F.lit(step)), below))


def _by_ranges(rows: DataFrame) -> DataFrame:
    """Deal rows to partitions by ranges of doc_id.  Bounds come from a scan of that column alone, where
    repartitionByRange would read whole texts to sample them.  A bound that repeats marks a doc_id with many rows: they
    are dealt over the ranges that it bounds."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = [i / parts for i in range(1, parts)]
    bounds = sorted(int(b) for b in rows.select(key.alias("k")).approxQuantile("k", cuts, 0.1 / parts)) if cuts else []
    if not bounds:
        return rows.coalesce(1) if parts == 1 else rows.repartition(1)
    low, high = _rank(bounds, True, key), _rank(bounds, False, key)
    return rows.repartitionById(parts, (low + F.floor(F.rand(42) * (high - low + 1))).cast("int"))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, special_as_text: bool = False) -> None:
    """Write doc_id, n_tokens and ids of every row, files and rows in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = _by_ranges(rows).sortWithinPartitions("doc_id")
    encoded = ordered.mapInArrow(_encode(path or tokenizer_path(), end_id, special_as_text), "doc_id long, n_tokens int, ids array<int>")
    writer = encoded.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    writer.option("parquet.block.size", str(row_group_bytes)).option("compression", "zstd").parquet(folder)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from the files."""
    rows = spark.read.schema("doc_id long, n_tokens int, ids array<int>").parquet(folder)
    rows = rows.select("doc_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "ids")
    found = rows.mapInArrow(_checksums, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
    files = spark.read.schema("doc_id long, n_tokens int").parquet(folder).groupBy(F.col("_metadata.file_name").alias("f"))
    files = files.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.col("least").asc_nulls_first(), F.col("most").asc_nulls_first(), "f")) - F.col("n")  # a row a file
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    placed = found.withColumn("within", within).join(files.select("f", before.alias("before")), F.col("file") == F.col("f"))
    return placed.select("doc_id", (F.col("before") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_digests(spark, folder)
