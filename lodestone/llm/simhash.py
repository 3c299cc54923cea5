"""SimHash near-dedup with pigeonhole blocks.

A fingerprint has 64 bits; a bit is set if it is set in over half the hashes of a text's word shingles.  Two fingerprints
that differ in at most d bits agree on at least m - d of any m blocks, so joining on every choice of m - d blocks finds
all close pairs; each is then verified by its Hamming distance.  m is chosen from the number of distinct fingerprints, so
that chance meetings stay below one a fingerprint; any m finds the same links.

Equal fingerprints are one node.  A bucket (fingerprints that agree on a choice of blocks) of up to SMALL members is
joined with itself.  A larger one is linked without pairs: two members are within 2 bits exactly if flipping at most one
bit in each can make them equal, so each member emits itself and its one-bit variants over the bits outside its blocks,
and members that meet in a variant are tied to the least of them.  Buckets of up to LARGE members do that inside one
task's memory, still larger ones by a shuffle on the variant.  Every link is kept, and none costs a square.

Components come from rounds of alternating star operations on the link table, which is written to the shared folder
after each round.

Near-duplicates in the pipeline (``near_duplicates``) are texts that these links join, and beside them texts with a Jaccard
coefficient of five-word shingles >= 0.8.  At that similarity fingerprints differ in 5 to 14 bits, for which pigeonhole
blocks would have 4 bits; so the candidates for the coefficient come from MinHash bands and are verified exactly.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; repeated rows
give a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, release, table, text_slices

BITS = 64
SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
SMALL, LARGE = 64, 20_000
CHUNK = 1 << 15


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each run of n words (fewer words: of all of them), as big-endian unsigned numbers."""
    words = text.encode().lower().split() if text else []  # bytes.lower and bytes.split know ASCII only
    if not words:
        return np.empty(0, dtype=">u8")
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    k = max(1, len(words) - n + 1)
    last = ends[n - 1 :] if len(words) >= n else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:k].tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=k).astype(">u8")


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    hashes = shingle_hashes(text, n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(count: int, distance: int = MAX_DISTANCE) -> list[int]:
    """Masks of the bits that close pairs may share, for ``count`` distinct fingerprints."""
    blocks = distance + 1
    while blocks < 16 and count >> (BITS * (blocks - distance) // blocks) > 0:
        blocks += 1
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    single = [((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in range(blocks)]
    return [sum(single[b] for b in keep) for keep in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variant_links(free: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the members of one bucket: (fp, least fp that it shares a variant with)."""
    every = np.concatenate([fps, *(fps ^ bit for bit in free)])
    owner = np.tile(fps, len(free) + 1)
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    first = np.maximum.accumulate(np.where(np.r_[True, every[1:] != every[:-1]], np.arange(len(every)), 0))
    a, b = owner, owner[first]
    pairs = np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def close_links(fps: DataFrame, distance: int = MAX_DISTANCE, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all pairs within 2 bits."""
    if distance != 2:
        raise ValueError("links through one-bit variants are exact for a distance of 2")
    masks = [_signed(m) for m in block_masks(fps.count(), distance)]
    blocks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(m).bitwiseAND(F.col("fp")).alias("block")) for m in masks])
    keyed = fps.select("fp", F.explode(blocks).alias("k")).select("fp", "k.mask", "k.block")
    sizes = keyed.groupBy("mask", "block").count().where("count > 1")
    members = materialize(keyed.join(sizes, ["mask", "block"]))
    few, many = members.where(F.col("count") <= small), members.where(F.col("count") > small)
    right = few.select("mask", "block", F.col("fp").alias("other"))
    pairs = few.join(right, ["mask", "block"]).where((F.col("other") < F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    links = pairs.select(F.col("fp").alias("a"), F.col("other").alias("b"))

    def inside(bucket: pd.DataFrame) -> pd.DataFrame:
        mask = int(bucket["mask"].iloc[0])
        free = np.array([_signed(1 << i) for i in range(BITS) if not mask >> i & 1], dtype=np.int64)
        a, b = _variant_links(free, np.sort(bucket["fp"].to_numpy()))
        return pd.DataFrame({"a": a, "b": b})

    middling = many.where(F.col("count") <= large).select("mask", "block", "fp").groupBy("mask", "block").applyInPandas(inside, "a long, b long")
    one_bit = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    outside = F.filter(one_bit, lambda bit: bit.bitwiseAND(F.col("mask")) == 0)
    huge = many.where(F.col("count") > large).select("mask", "block", "fp", F.explode(outside).alias("bit"))
    huge = huge.select("mask", "block", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("variant"))
    least = huge.groupBy("mask", "block", "variant").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    spread = huge.join(least, ["mask", "block", "variant"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return links.unionByName(middling).unionByName(spread).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): root is the least node of the component.  Alternating large and small stars.

    The partial result shrinks to a forest of stars in a number of rounds that grows with the logarithm of the longest
    path; the driver only sees two sums a round.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen: tuple | None = None
    while True:  # each round that changes something lowers a root, so it ends
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = materialize(both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        tied = large.join(low, F.col("a") == F.col("n"))
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        before, links = links, materialize(small.where("a <> b").distinct())
        release(large)
        release(before)
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    rows = materialize(fingerprints(docs, shingle))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(close_links(nodes.select("fp"), distance))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = materialize(named)
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "component_id"), "fp")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


# Near-duplicates: close fingerprints, and beside them five-word shingles with Jaccard >= 0.8.

BANDS, BAND_ROWS = 24, 4
#: Fixed odd multipliers, from a rule: the permutations of the MinHash sketch.
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"minhash%d" % i, SEED) | 1 for i in range(BANDS * BAND_ROWS)], dtype=np.uint64)
PAIR_BUCKET, TASK_BUCKET = 32, 4000
#: Narrow rows (three numbers) that may be broadcast, so that texts are not shuffled.
FEW = 500_000
_TEXT_KEY = "xxhash64(text)"


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, n).astype(np.int64))


def band_keys(found: np.ndarray) -> list[int]:
    """One key a band of the MinHash sketch; sets with Jaccard 0.8 share none with a probability of 3e-6."""
    if not len(found):
        return []
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), CHUNK // 8):
        least = np.minimum(least, (found[at : at + CHUNK // 8].astype(np.uint64)[:, None] * _MULTIPLIERS).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [_signed(xxhash.xxh64_intdigest(rows[b].tobytes(), b)) for b in range(BANDS)]


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, fp, set_key (equal exactly for equal shingle sets), the set's size and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").to_pylist()
                sets = [shingle_set(t, shingle) for t in texts]
                columns = [[fingerprint(t) for t in texts], [xxhash.xxh128_digest(s.tobytes()) for s in sets], [len(s) for s in sets], [band_keys(s) for s in sets]]
                types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
                made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *made], ["doc_id", "text_key", "fp", "set_key", "size", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(_TEXT_KEY).alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long, set_key binary, size int, bands array<long>")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, text) -> node, grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = [shingle_set(t, shingle) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

    return texts.mapInArrow(run, "node long, grams array<long>")


def _forest(similarity: float):
    """Within one pair of chunks of a large bucket: links that join all members that close pairs join."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("node")
        nodes, grams = bucket["node"].to_numpy(), [np.asarray(g) for g in bucket["grams"]]
        sizes = np.array([len(g) for g in grams])
        order = np.argsort(sizes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        label = np.arange(len(nodes))
        sketch = np.stack([(g.astype(np.uint64)[:, None] * _MULTIPLIERS).min(axis=0) for g in grams])
        out: list[tuple[int, int]] = []
        for i in order.tolist():
            # only members of other trees, not smaller, and not too large for the similarity
            rest = np.flatnonzero((label != label[i]) & (place > place[i]) & (sizes[i] >= similarity * sizes))
            # the estimate only orders the tests: pairs that look close come first, so that most others are joined by then
            for j in rest[np.argsort(-(sketch[rest] == sketch[i]).sum(axis=1), kind="stable")].tolist():
                if label[i] == label[j]:
                    continue
                both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
                if both >= similarity * (sizes[i] + sizes[j] - both):
                    label[label == label[j]] = label[i]
                    out.append((int(max(nodes[i], nodes[j])), int(min(nodes[i], nodes[j]))))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _alike(nodes: DataFrame) -> DataFrame:
    """(node, fp) -> links (a, b) from each node to the least one of its fingerprint's component."""
    found = components(close_links(materialize(nodes.select("fp").distinct()))).withColumnRenamed("node", "_fp")
    placed = materialize(nodes.join(found, F.col("fp") == F.col("_fp"), "left").select("node", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return placed.join(least, "root").where("node <> b").select(F.col("node").alias("a"), "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key, group_id and kept of every distinct doc_id and text: groups are the components of pairs whose
    fingerprints are within MAX_DISTANCE bits and of pairs with Jaccard >= ``similarity``, group_id is a group's least doc_id,
    and kept is true of one of its texts, the first of that doc_id.

    Texts with equal fingerprints and shingle sets are one node.  Fingerprints are linked as in ``simhash_components``.  MinHash
    buckets of up to PAIR_BUCKET nodes give pairs, larger ones are linked inside a task that holds at most two chunks of
    TASK_BUCKET nodes; both verify by the exact coefficient.
    """
    rows = materialize(_sketches(docs, shingle))
    nodes = rows.groupBy("set_key", "fp").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    # buckets of different bands with the same members, as near copies make them, give the same links: one of them is enough
    marks = [F.bit_xor(F.xxhash64("node")).alias("_x"), F.sum(F.xxhash64(F.lit(SEED), "node").cast("decimal(38,0)")).alias("_s")]
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), *marks).where("n > 1")
    sizes = sizes.groupBy("n", "_x", "_s").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "n")
    members = materialize(keyed.join(sizes, ["band", "key"]))
    few = members.where(F.col("n") <= PAIR_BUCKET)
    pairs = few.join(few.select("band", "key", F.col("node").alias("other"), F.col("size").alias("other_size")), ["band", "key"]).where("other < node")
    fits = F.least("size", "other_size") >= similarity * F.greatest("size", "other_size")
    pairs = materialize(pairs.where(fits).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    many = members.where(F.col("n") > PAIR_BUCKET)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(many.select("node")).distinct()
    named = broadcast_if_small(materialize(nodes.join(wanted, "node", "left_semi").select("node", "least.*")), FEW)  # else whole texts are shuffled
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.expr(_TEXT_KEY).alias("_key"), "text")
    texts = texts.join(named, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))).select("node", "text")
    sets = materialize(_shingle_sets(texts, shingle).groupBy("node").agg(F.first("grams").alias("grams")))
    x, y = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    close = pairs.join(x, "a").join(y, "b").where(both >= similarity * (F.size("ga") + F.size("gb") - both)).select("a", "b")
    many = many.join(sets, "node")
    chunks = F.ceil(F.col("n") / TASK_BUCKET).cast("int")
    many = many.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    against = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("lo"), F.greatest(c, F.col("chunk")).alias("hi")))
    many = many.select("band", "key", "node", "grams", F.explode(against).alias("cell"))
    linked = many.groupBy("band", "key", "cell").applyInPandas(_forest(similarity), "a long, b long")
    links = close.unionByName(linked).unionByName(_alike(nodes.select("node", "fp")))
    roots = components(links).withColumnRenamed("node", "_node")
    grouped = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("set_key", "fp", "least", F.coalesce("root", "node").alias("root"))
    grouped = materialize(grouped)
    first = grouped.groupBy("root").agg(F.min("least").alias("first"))
    named = grouped.join(first, "root").select("set_key", "fp", "first")
    found = rows.select("doc_id", "text_key", "set_key", "fp").join(named, ["set_key", "fp"])
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return found.select("doc_id", "text_key", F.col("first.doc_id").alias("group_id"), kept.alias("kept")).distinct()


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one text of each group; rows that repeat its doc_id and text are one document and stay with it."""
    gone = near_duplicates(docs, shingle, similarity).where("not kept")
    gone = materialize(gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")))
    gone = broadcast_if_small(gone, FEW)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(gone, same, "left_anti")
