"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Benchmark items become windows of 13 words (an item with fewer is one window).  The hash of a window's first, middle
and last word goes into a hash set of bits that the plan carries to every task; a document's words are scanned once against
it, and only positions whose bit is set have their whole window built, which is then verified by an exact join with the
windows themselves.  Documents without a candidate cross the shuffle as one narrow row.

The set has SPARSE bits for each window, MOST_BITS at most (8 MB): a larger benchmark fills it more densely, so more
candidates reach the join, and nothing else changes.  The join is a broadcast one if the windows have been counted to be few.

Defined cases: null text has no words, so no hits; an item without words has no window; an item without id marks words
but is not listed; every input row gives a row, repeated doc_ids too; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

WINDOW = 13
MAX_BROADCAST = 100_000
SPARSE, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 26
#: What separates words after lower-casing, and before it.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, -1), "")


def _signature(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.get(words, at), F.get(words, at + length // 2), F.get(words, at + length - 1), F.lit(length))


def _window_text(words: Column, at: Column, length: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + k) for k in range(length)])


def _starts(words: Column, length: int) -> Column:
    n = F.size(words)
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, window, signature, items): distinct windows with the ids, as strings, of the items that hold them."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("length", F.least(F.size("w"), F.lit(window)))
    found = []
    for length in range(1, window + 1):
        own = rows.where(F.col("length") == length).select("item", "length", "w", F.explode(_starts(F.col("w"), length)).alias("at"))
        found.append(own.select("item", "length", _window_text(F.col("w"), F.col("at"), length).alias("window"), _signature(F.col("w"), F.col("at"), length).alias("signature")))
    union = found[0]
    for other in found[1:]:
        union = union.unionByName(other)
    return union.groupBy("length", "window", "signature").agg(F.collect_set("item").alias("items"))


def _slot(signature: Column, bits: int) -> tuple[Column, Column]:
    """Which of the set's 64-bit words, and which of its bits."""
    return F.shiftright(signature.bitwiseAND(bits - 1), 6).cast("int"), signature.bitwiseAND(63).cast("int")


def _bit_set(windows: DataFrame, count: int) -> tuple[Column, int]:
    """The set of the windows' signatures as a constant array of 64-bit words, and its number of bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SPARSE * max(1, count) - 1).bit_length()))
    word, bit = _slot(F.col("signature"), bits)
    one = F.expr("shiftleft(1L, bit)")
    found = windows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(one).alias("set")).collect()  # MOST_BITS / 64 rows at most
    values = ["0"] * (bits // 64)
    for r in found:
        values[r.word] = str(r.set)
    return F.split(F.lit(",".join(values)), ",").cast("array<bigint>"), bits  # folded to one literal


def _candidates(words: Column, length: int, known: Column, bits: int) -> Column:
    """array<struct<at, length, signature, window>> of the positions whose bit is set."""
    each = F.transform(_starts(words, length), lambda at: F.struct(at.alias("at"), _signature(words, at, length).alias("signature")))

    def is_known(x: Column) -> Column:
        word, bit = _slot(x["signature"], bits)
        return F.getbit(F.get(known, word), bit) == 1

    return F.transform(
        F.filter(each, is_known), lambda x: F.struct(x["at"].alias("at"), F.lit(length).alias("length"), x["signature"].alias("signature"), _window_text(words, x["at"], length).alias("window"))
    )


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, spans array<struct<at, length>> of occurrences, item ids, n_hit, contaminated."""
    windows = materialize(benchmark_windows(items, window))
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # window lengths: at most 13
    count = windows.count()
    known, bits = _bit_set(windows, count)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), item_words(F.col("text")).alias("_w"))
    parts = [_candidates(F.col("_w"), length, known, bits) for length in lengths]
    none = F.array().cast("array<struct<at:int,length:int,signature:bigint,window:string>>")
    rows = rows.select("doc_id", "_row", F.size("_w").cast("long").alias("n_words"), F.explode_outer(F.concat(none, *parts)).alias("f"))
    right = F.broadcast(windows) if count <= max_broadcast else windows
    seen = rows.select("doc_id", "_row", "n_words", "f.at", "f.length", "f.signature", "f.window").join(right, ["signature", "length", "window"], "left")
    span = F.when(F.col("items").isNotNull(), F.struct("at", "length"))
    whole = seen.groupBy("_row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_list(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["at"] + s["length"]).alias("end"),
            (a["hit"] + F.greatest(F.lit(0), s["at"] + s["length"] - F.greatest(a["end"], s["at"]))).alias("hit"),
        ),
        lambda a: a["hit"],
    )
    return whole.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("_row")


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or (``mode='spans'``) with every hit word taken out of the texts.

    Documents are told apart by doc_id; rows that share one share the decision.
    """
    hits = find_hits(docs, items, window)
    if mode == "documents":
        bad = materialize(hits.where("contaminated").select(F.col("doc_id").alias("__bad")).distinct())
        return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")
    if mode != "spans":
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    marked = hits.where("n_hit > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.first("spans").alias("__spans"))
    wide = docs.join(materialize(marked), docs["doc_id"].eqNullSafe(F.col("__id")), "left")
    wide = wide.withColumn("__words", F.regexp_extract_all("text", F.lit(CASED_WORD), F.lit(0))).withColumn("__gaps", F.split("text", CASED_WORD, -1))

    def kept(i: Column) -> Column:
        inside = F.exists("__spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["length"]))
        return F.concat(F.get("__gaps", i), F.when(inside, F.lit("")).otherwise(F.get("__words", i)))

    pieces = F.transform(F.when(F.size("__words") > 0, F.sequence(F.lit(0), F.size("__words") - 1)), kept)
    clean = F.concat(F.array_join(pieces, ""), F.element_at("__gaps", -1))
    return wide.withColumn("text", F.when(F.col("__spans").isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bl AS (SELECT *, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT d.rid, d.w, ns.n, unnest(range(1, len(d.w) - ns.n + 2)) AS i FROM d, ns WHERE len(d.w) >= ns.n)),
m AS (SELECT dw.rid, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM m)) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN k ON d.rid = k.rid
"""
