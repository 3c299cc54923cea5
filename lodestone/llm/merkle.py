"""Merkle manifest of a dataset: a digest for every row, one for every source, one for all, and a proof for every row.

Rows are leaves.  Each source's leaves, in order of doc_id, form a tree in which every 16 consecutive nodes become one; the
sources' roots form such a tree again.  Blocks of 16**LEVELS leaves, aligned to the tree, are traversed within a task:
recursively, in postorder, each call returns the digest of its subtree and, while unwinding, appends the siblings of each
child to the leaves that the child contains.  The roots of the blocks are the leaves of the next distributed traversal, and
so on until a source has one node left.  What a block's leaves still need, the siblings above the block, comes down the
same way: each traversal joins the proofs of its blocks.

A leaf's place in its source comes from files, not from a window over the source: narrow rows are range-partitioned by
source and doc_id, sorted and written, and a row's place is its index in its file, less the first of its source there,
plus the counts of its source in earlier files.  So a source with a third of all rows is spread like any other.

Texts are hashed where they are read; after that only doc_id, source and digests move.

Defined cases: a null field is ``-``; a null source is a source of its own, before all others; null doc_ids come first;
rows that share source and doc_id follow their leaf digests, and equal rows are leaves of their own, in any order, as
their digests are equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialize, scratch, table

FANOUT = 16
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each as its byte count, a colon and its UTF-8 form, or ``-`` for null."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def height(n: Column) -> Column:
    """Levels above n leaves until one node is left."""
    return sum(((n > F.lit(FANOUT**k)).cast("int") for k in range(1, 15)), (n > 1).cast("int"))


def traverse(nodes: list[str], levels: int, steps: list[list[tuple[str, str]]] | None = None, start: int = 0) -> str:
    """The digest of the subtree of ``levels`` levels over ``nodes[start:]``, as far as it reaches.  To the list of each leaf
    in it goes, level by level, what stands to the left and to the right of its branch."""
    if not levels:
        return nodes[start]
    wide = FANOUT ** (levels - 1)
    starts = range(start, min(start + FANOUT * wide, len(nodes)), wide)
    children = [traverse(nodes, levels - 1, steps, at) for at in starts]
    if steps is not None:
        for i, at in enumerate(starts):
            step = ("".join(children[:i]), "".join(children[i + 1 :]))
            for own in steps[at : at + wide]:
                own.append(step)
    return sha256("".join(children).encode()).hexdigest()


def fold(digest: str, steps: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its way up give."""
    for left, right in steps:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def number(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add pos (0, 1, ... in each group, by ``order``, nulls first) and n (rows of the group)."""
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "sorted")
    rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path).select(*rows.columns, "part", F.col("_metadata.row_index").alias("at"))
    runs = placed.groupBy(F.col("part").alias("p"), F.col(group).alias("g")).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy("g")
    before = F.sum("here").over(whole.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")
    runs = broadcast_if_small(materialize(runs.select("p", "g", (before - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n"))))
    out = placed.join(runs, (F.col("part") == F.col("p")) & (F.col(group) == F.col("g")))
    return out.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """The block of each node, its place there, and the levels to climb in the block."""
    size = FANOUT**levels
    return nodes.withColumn("block", F.floor(F.col("pos") / size)).withColumn("slot", (F.col("pos") % size).cast("int")).withColumn("levels", F.least(F.lit(levels), height(F.col("n"))))


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """(key, pos, n, digest) -> the nodes of each traversal in turn; the last have one row a key, its root."""
    size = FANOUT**levels

    def root_of_block(group: pa.Table) -> pa.Table:
        group = group.sort_by("slot")
        root = traverse(group["digest"].to_pylist(), group["levels"][0].as_py())
        n = -(-group["n"][0].as_py() // size)
        return pa.table({"key": group["key"].slice(0, 1), "pos": group["block"].slice(0, 1), "n": pa.array([n], pa.int64()), "digest": pa.array([root], pa.string())})

    out = [nodes]
    while True:
        here = _blocks(out[-1], levels).select("key", "block", "slot", "levels", "n", "digest")
        out.append(materialize(here.groupBy("key", "block").applyInArrow(root_of_block, "key string, pos long, n long, digest string")))
        if not out[-1].where("n > 1").limit(1).count():
            return out


def _steps_of(nodes: pa.Table, above: pa.Table) -> tuple[pa.Table, list[list[tuple[str, str]]], list[tuple[str, str]]]:
    nodes = nodes.sort_by("slot")
    steps: list[list[tuple[str, str]]] = [[] for _ in range(len(nodes))]
    traverse(nodes["digest"].to_pylist(), nodes["levels"][0].as_py(), steps)
    return nodes, steps, [(s["left"], s["right"]) for s in above["steps"][0].as_py()]


_DOWN = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("steps", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])
_PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The leaves of a block with the digest of their siblings and the root that leaf (the tampered one, where there is one) and siblings give."""
    if not len(nodes) or not len(above):
        return _PROOF.empty_table()
    nodes, steps, upper = _steps_of(nodes, above)
    leaves, tampered = nodes["digest"].to_pylist(), nodes["tampered"].to_pylist()
    proofs, roots = [], []
    for leaf, other, own in zip(leaves, tampered, steps, strict=True):
        own += upper
        proofs.append(sha256("".join(a + b for a, b in own).encode()).hexdigest())
        roots.append(fold(other or leaf, own))
    subroot = pa.array([above["subroot"][0].as_py()] * len(nodes), pa.string())
    return pa.table([nodes["doc_id"], nodes["digest"], subroot, pa.array(proofs, pa.string()), pa.array(roots, pa.string())], schema=_PROOF)


def _meet(nodes: DataFrame, above: DataFrame, levels: int, extra: Sequence[str] = ()):
    """Nodes by block, with what is above each block."""
    here = _blocks(nodes, levels).select("key", "block", "slot", "levels", "digest", *extra)
    upper = above.select("key", F.col("pos").alias("block"), "subroot", "steps")
    return here.groupBy("key", "block").cogroup(upper.groupBy("key", "block"))


def _descend(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(key, pos, subroot, steps) of nodes: their own steps within their block, and then the block's."""
    size = FANOUT**levels

    def run(own: pa.Table, over: pa.Table) -> pa.Table:
        if not len(own) or not len(over):
            return _DOWN.empty_table()
        own, steps, upper = _steps_of(own, over)
        rows = [[{"left": a, "right": b} for a, b in [*x, *upper]] for x in steps]
        subroot = pa.array([over["subroot"][0].as_py()] * len(own), pa.string())
        pos = pa.array([b * size + s for b, s in zip(own["block"].to_pylist(), own["slot"].to_pylist(), strict=True)], pa.int64())
        return pa.table([own["key"], pos, subroot, pa.array(rows, _DOWN.field("steps").type)], schema=_DOWN)

    return _meet(nodes, above, levels).applyInArrow(run, f"key string, pos long, subroot string, steps {_STEP}")


def manifest(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``tampered``: a text to fold in place of a row's own (null: its own); it must keep nulls."""
    columns = [F.col(c) for c in fields]
    other = F.lit(None).cast("string")
    if tampered is not None:
        swapped = [F.col("_other") if c == "text" else F.col(c) for c in fields]
        other = F.when(F.col("_other").isNotNull(), leaf_digest(swapped))
    text = docs.select(*fields, (tampered if tampered is not None else other).alias("_other"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null is the empty key, before all others
    leaves = materialize(text.select("doc_id", key.alias("key"), leaf_digest(columns).alias("digest"), other.alias("tampered")))
    numbered = number(leaves, "key", ["doc_id", "digest"])
    frames = climb(numbered.select("key", "pos", "n", "digest"), levels)

    subroots = frames[-1].select(F.lit("").alias("key"), F.col("key").alias("source_key"), "digest")
    sources = number(subroots, "key", ["source_key"])
    tree = climb(sources.select("key", "pos", "n", "digest"), levels)
    top = tree[-1].first()
    root = top.digest if top else ""

    none = F.array().cast(_STEP)
    above = tree[-1].select("key", F.lit(0).cast("long").alias("pos"), F.lit("").alias("subroot"), none.alias("steps"))
    for nodes in reversed(tree[:-1]):
        above = _descend(nodes, above, levels)
    named = sources.select("pos", F.col("source_key").alias("key"), F.col("digest").alias("subroot"))
    above = named.join(above.select("pos", "steps"), "pos").select("key", F.lit(0).cast("long").alias("pos"), "subroot", "steps")
    for nodes in reversed(frames[1:-1]):
        above = _descend(nodes, above, levels)
    proved = _meet(numbered, above, levels, ["doc_id", "tampered"]).applyInArrow(_prove, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proved.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text")))
    return manifest(table(spark, sf_dir, "documents"), lowered)


OP11_SQL = r"""
WITH RECURSIVE
f AS (SELECT doc_id, coalesce('=' || source, '') AS key,
        coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
        || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
        coalesce(strlen(text)::VARCHAR || ':', '-') AS size, coalesce(text, '') AS text,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) AS crc
      FROM documents),
l AS (SELECT doc_id, key, sha256(head || size || text) AS leaf,
             CASE WHEN crc % 5 = 0 THEN sha256(head || size || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS tampered FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM l),
t AS (SELECT 0 AS lvl, key, pos, n, leaf AS digest FROM d
      UNION ALL
      SELECT lvl + 1, key, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, key, pos // 16, n),
s AS (SELECT key, digest, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
st AS (SELECT 0 AS lvl, '' AS key, pos, n, digest FROM s
       UNION ALL
       SELECT lvl + 1, '', pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM st WHERE n > 1 GROUP BY lvl, pos // 16, n),
g AS (SELECT lvl, key, pos // 16 AS up, list(digest ORDER BY pos) AS own FROM t WHERE n > 1 GROUP BY ALL),
sg AS (SELECT lvl, pos // 16 AS up, list(digest ORDER BY pos) AS own FROM st WHERE n > 1 GROUP BY ALL),
w AS (SELECT key, pos AS leaf_pos, 0 AS lvl, pos, coalesce(tampered, leaf) AS digest, '' AS proof FROM d
      UNION ALL
      SELECT w.key, leaf_pos, w.lvl + 1, pos // 16,
             sha256(array_to_string(own[1:pos % 16], '') || digest || array_to_string(own[pos % 16 + 2:], '')),
             proof || array_to_string(own[1:pos % 16], '') || array_to_string(own[pos % 16 + 2:], '')
      FROM w JOIN g ON g.lvl = w.lvl AND g.key = w.key AND g.up = w.pos // 16),
wt AS (SELECT key, leaf_pos, digest, proof FROM w QUALIFY row_number() OVER (PARTITION BY key, leaf_pos ORDER BY lvl DESC) = 1),
v AS (SELECT wt.key, leaf_pos, 0 AS lvl, s.pos, wt.digest, wt.proof FROM wt JOIN s ON s.key = wt.key
      UNION ALL
      SELECT v.key, leaf_pos, v.lvl + 1, pos // 16,
             sha256(array_to_string(own[1:pos % 16], '') || digest || array_to_string(own[pos % 16 + 2:], '')),
             proof || array_to_string(own[1:pos % 16], '') || array_to_string(own[pos % 16 + 2:], '')
      FROM v JOIN sg ON sg.lvl = v.lvl AND sg.up = v.pos // 16),
vt AS (SELECT key, leaf_pos, digest, proof FROM v QUALIFY row_number() OVER (PARTITION BY key, leaf_pos ORDER BY lvl DESC) = 1),
r AS (SELECT digest AS root FROM st WHERE n = 1)
SELECT d.doc_id, d.leaf, s.digest AS subroot, root, sha256(vt.proof) AS proof_sha256, vt.digest AS folded_root, vt.digest = root AS verified
FROM d JOIN s ON s.key = d.key JOIN vt ON vt.key = d.key AND vt.leaf_pos = d.pos CROSS JOIN r
"""
