"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words.  A document's expected number of copies is proportional to its importance, cut at
MAX_COPIES, at the rate that makes the expected words of the source its target: the whole part is allocated for certain, the
fraction is an inclusion probability ``p``, which differs from document to document.  Documents are ranked by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))`` (Rosen's Pareto order sampling), and the
sample is the head of that ranking that stays within what the whole copies leave of the target, and of the documents after it
the one whose size comes nearest to the rest (if that is nearer than none).

The head is found without sorting a source: ranks are cut into 2**24 cells, and three rounds of 256-way histograms
narrow down the cell in which the running sum of words crosses the remainder.  A round shuffles at most 256 rows for
each source and task, so a source with a third of all rows costs no more than any other.  The rate is found from the words
of each level of importance (its first 8 bits are a level).

The default importance of a document is the number of binary digits of its size: of two documents, the one with the more
text is the more likely to be taken, and to be repeated.

Defined cases: null or blank text has size 0 and is never taken; null, negative or non-finite importance counts as 0, and a
document of importance 0 is never taken; a null source is a source of its own, last in order;
rows that repeat a doc_id share its random number, so they are taken together; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table, unit_interval

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
CELL_BITS, ROUND_BITS = 24, 8
WORD = r"[^\x20\x09-\x0D]+"


def word_size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> plus target: ``share`` of all words dealt by cyclic weights, at most ``cap`` times a size.

    What sources at their cap cannot take goes to the others by weight.  With the sources in order of size over weight,
    the capped ones are a head of that order, so the level that the rest share is found by two running sums (at the
    first source that is not above its cap) instead of by repeated resharing.  One row a source; the single-partition window is over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("_w"), "_n")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("_n", F.row_number().over(by_name)).withColumn("_w", pick)
    levels = (
        ranked.withColumn("_cap", F.lit(cap) * F.col("source_size"))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("_full")) / F.col("_rest"))
        .withColumn("_k", F.row_number().over(order))
        .withColumn("_first", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_k", "_level"))).over(everything))
    )
    free = F.coalesce(F.col("_k") >= F.col("_first._k"), F.lit(False))
    target = F.when(free, F.col("_first._level") * F.col("_w")).otherwise(F.col("_cap").cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def size_importance(size: Column) -> Column:
    return F.length(F.bin(size)).cast("double")


def _level(weight: Column) -> Column:
    """``weight`` cut to its first 8 binary digits; integers below 256 stay as they are.

    The one-element array makes the weight, which may count the words of a text, once.
    """

    def cut(w: Column) -> Column:
        unit = F.pow(F.lit(2.0), F.floor(F.log2(w)) - 7)
        return F.when((w > 0) & (w < float("inf")), F.floor(w / unit) * unit).otherwise(0.0)

    return F.get(F.transform(F.array(weight.cast("double")), cut), 0)


def _expected(weight: Column) -> tuple[Column, Column]:
    """Whole copies and the inclusion probability of one more."""
    copies = F.least(F.coalesce(F.col("_rate") * weight, F.lit(0.0)), F.lit(float(MAX_COPIES)))
    return F.floor(copies), copies - F.floor(copies)


def _rates(levels: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, words) and targets -> targets plus _rate, at which a source's expected words are its target.

    From the largest weight down, the levels at MAX_COPIES are a head of the order; the rest share what they leave.
    """
    w = levels.where((F.col("weight") > 0) & (F.col("words") > 0)).select(F.col("source").alias("_source"), "weight", "words")
    joined = targets.join(w, F.col("source").eqNullSafe(F.col("_source")), "left")
    order = Window.partitionBy("source").orderBy(F.desc("weight"))
    full = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("weight")).over(Window.partitionBy("source").orderBy("weight"))  # this weight and all below
    rate = F.try_divide(F.col("target") - MAX_COPIES * full, rest)
    rated = joined.withColumn("_rate", rate).groupBy("source", "source_size", "target").agg(
        F.max_by("_rate", F.when(F.col("_rate") * F.col("weight") <= MAX_COPIES, F.col("weight"))).alias("_free"), F.min("weight").alias("_least")
    )
    return rated.select("source", "source_size", "target", F.coalesce("_free", F.try_divide(F.lit(float(MAX_COPIES)), F.col("_least"))).alias("_rate"))


def _cell(u: Column, p: Column) -> Column:
    """The Pareto rank, mapped from (0, inf) to a cell; documents with p = 0 come after all others."""
    odds = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p > 0, F.floor(odds / (1 + odds) * float(1 << CELL_BITS))).otherwise(F.lit(1 << CELL_BITS)).cast("long")


def mixing_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    importance: Callable[[Column], Column] = size_importance,
    size: Column | None = None,
    seed: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, size, u, weight) and, for each source, (source, source_size, target, _rate, _cut, _fill_cell, _fill_id).

    ``importance`` maps the column of sizes (or, ignoring it, other columns of ``docs``) to the documents' importance.
    """
    words = word_size() if size is None else size
    rows = docs.select("doc_id", "source", words.alias("size"), unit_interval(F.col("doc_id"), seed).alias("u"), _level(importance(words)).alias("weight"))
    rows = materialize(rows)
    levels = materialize(rows.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    targets = source_targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share)
    plan = materialize(_rates(levels, targets))
    whole, p = _expected(F.col("weight"))
    ranked = _with_plan(rows, plan).withColumn("_whole", whole).withColumn("_p", p).withColumn("_cell", _cell(F.col("u"), F.col("_p")))
    rest = F.first("target") - F.sum(F.col("size") * F.col("_whole"))
    left = ranked.groupBy("source").agg(rest.alias("_left"), F.sum(F.when(F.col("_p") > 0, F.col("size"))).alias("_words"))
    left = materialize(left.withColumn("_all", F.coalesce(F.col("_words") <= F.col("_left"), F.lit(False))))  # then there is no crossing
    zero = F.lit(0).cast("long")
    state = left.where(~F.col("_all")).select("source", "_left", zero.alias("_prefix"), zero.alias("_before"))
    for step in range(CELL_BITS // ROUND_BITS):
        state = _narrow(ranked.where(F.col("_p") > 0), state, CELL_BITS - ROUND_BITS * (step + 1))
    state = materialize(state)
    cuts = _filled(ranked.where(F.col("_p") > 0), state).unionByName(
        left.where("_all").select(F.col("source").alias("_source"), F.lit(1 << CELL_BITS).cast("long").alias("_cut")), allowMissingColumns=True
    )
    done = plan.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return rows, materialize(done.withColumn("_cut", F.coalesce("_cut", F.lit(0).cast("long"))))


def _filled(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """(_source, _cut, _fill_cell, _fill_id): the cell where each source's head ends, and the document that fills its rest best."""
    rest = F.col("_left") - F.col("_before")
    s = state.select(F.col("source").alias("_source"), "_prefix", rest.alias("_rest"))
    later = ranked.select("source", "doc_id", "size", "_cell").join(s, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("_cell") >= F.col("_prefix"))
    best = F.min(F.struct(F.abs(F.col("size") - F.col("_rest")).alias("off"), F.col("_cell").alias("cell"), F.col("doc_id").alias("id")))
    picks = materialize(later.groupBy("source", "_rest").agg(best.alias("pick")).select(F.col("source").alias("_s"), F.col("_rest").alias("_r"), "pick"))
    # rows that repeat the document are taken with it
    same = ranked.select("source", "doc_id", "size", "_cell").join(picks, F.col("source").eqNullSafe(F.col("_s")))
    same = same.where((F.col("_cell") == F.col("pick.cell")) & F.col("doc_id").eqNullSafe(F.col("pick.id")))
    fits = same.groupBy("_s", "_r", "pick").agg(F.sum("size").alias("words")).where(F.abs(F.col("_r") - F.col("words")) < F.col("_r"))
    fits = fits.select("_s", F.col("pick.cell").alias("_fill_cell"), F.col("pick.id").alias("_fill_id"))
    return state.select(F.col("source").alias("_source"), F.col("_prefix").alias("_cut")).join(fits, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan, joined null-safely; the plan has one row a source and is broadcast if counted small."""
    own = [c for c in plan.columns if c != "source"]
    right = broadcast_if_small(plan.select(F.col("source").alias("_source"), *own))
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _narrow(ranked: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """One round: from a prefix of the cell number to a prefix ROUND_BITS longer, with the words before it.

    Every source in ``state`` has a cell that crosses its remainder.
    """
    s = state.select(F.col("source").alias("_source"), "_left", "_prefix", "_before")
    inside = ranked.select("source", "size", "_cell").join(s, F.col("source").eqNullSafe(F.col("_source")))
    inside = inside.where(F.shiftright("_cell", shift + ROUND_BITS) == F.col("_prefix"))
    words = inside.groupBy("source", "_left", "_before", F.shiftright("_cell", shift).alias("_next")).agg(F.sum("size").alias("_words"))
    running = F.col("_before") + F.sum("_words").over(Window.partitionBy("source").orderBy("_next"))
    crossing = words.withColumn("_run", running)
    hit = F.min(F.when(F.col("_run") > F.col("_left"), F.struct("_next", (F.col("_run") - F.col("_words")).alias("b"))))
    found = crossing.groupBy("source").agg(F.first("_left").alias("_left"), hit.alias("_hit"))
    return found.select("source", "_left", F.col("_hit._next").alias("_prefix"), F.col("_hit.b").alias("_before"))


def copies_taken(weight: Column, u: Column, doc_id: Column) -> Column:
    """Copies of a document, on rows that carry its source's plan."""
    whole, p = _expected(weight)
    cell = _cell(u, p)
    fills = F.coalesce((cell == F.col("_fill_cell")) & doc_id.eqNullSafe(F.col("_fill_id")), F.lit(False))
    return (whole + ((cell < F.col("_cut")) | fills).cast("long")).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, importance: Callable[[Column], Column] = size_importance, seed: str = "") -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with the input's columns."""
    _, plan = mixing_plan(docs, weights, share, importance, seed=seed)
    # a struct: no column of docs can clash with the plan's
    whole = docs.select(F.struct("*").alias("row"), F.col("source"), _level(importance(word_size())).alias("weight"))
    copies = copies_taken(F.col("weight"), unit_interval(F.col("row.doc_id"), seed), F.col("row.doc_id")).cast("int")
    blank = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    wide = _with_plan(whole, plan).where(blank).withColumn("copies", copies).where("copies > 0")
    return wide.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan = mixing_plan(table(spark, sf_dir, "documents"))
    taken = F.col("size") * copies_taken(F.col("weight"), F.col("u"), F.col("doc_id"))
    return _with_plan(rows, plan).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM documents),
lv AS (SELECT source, length(bin(size)) AS weight, sum(size)::BIGINT AS words FROM d GROUP BY ALL HAVING sum(size) > 0),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
v AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt, 3 * source_size AS cap FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY source_size / wt, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(wt) OVER (ORDER BY source_size / wt, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM v),
i AS (SELECT *, row_number() OVER (ORDER BY source_size / wt, n) AS k FROM l),
f AS (SELECT *, min(CASE WHEN lev * wt <= cap THEN k END) OVER () AS first_k FROM i),
t AS (SELECT source, source_size, CASE WHEN k >= first_k THEN max(CASE WHEN k = first_k THEN lev END) OVER () * wt ELSE cap::DOUBLE END AS target FROM f),
ra AS (SELECT t.source, weight, (target - 3 * coalesce(sum(words) OVER (PARTITION BY t.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(words * weight) OVER (PARTITION BY t.source ORDER BY weight))::DOUBLE AS rate
       FROM t JOIN lv ON t.source IS NOT DISTINCT FROM lv.source),
rb AS (SELECT source, coalesce(arg_max(rate, weight) FILTER (rate * weight <= 3), 3.0::DOUBLE / min(weight)) AS rate FROM ra GROUP BY source),
e AS (SELECT d.doc_id, d.size, d.u, t.source, t.source_size, t.target, least(coalesce(rb.rate * length(bin(d.size))::DOUBLE, 0.0::DOUBLE), 3.0::DOUBLE) AS copies
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN rb ON d.source IS NOT DISTINCT FROM rb.source),
p AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p FROM e),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS odds FROM p),
c AS (SELECT *, CASE WHEN p > 0 THEN floor(odds / (1 + odds) * 16777216.0)::BIGINT ELSE 16777216 END AS cell FROM o),
r AS (SELECT source, target - sum(size * whole) OVER (PARTITION BY source) AS lft, cell, p, size, doc_id FROM c),
g AS (SELECT source, lft, cell, sum(size) AS words FROM r WHERE p > 0 GROUP BY source, lft, cell),
q AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY cell) AS run FROM g),
x AS (SELECT source, min(CASE WHEN run > lft THEN cell END) AS cell FROM q GROUP BY source),
k AS (SELECT x.source, coalesce(x.cell, 16777216) AS cut, q.lft - (q.run - q.words) AS rest FROM x LEFT JOIN q ON x.source IS NOT DISTINCT FROM q.source AND x.cell = q.cell),
n AS (SELECT r.source, r.cell, r.doc_id, k.rest, row_number() OVER (PARTITION BY r.source ORDER BY abs(r.size - k.rest), r.cell, r.doc_id NULLS FIRST) AS nth
      FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source WHERE r.p > 0 AND r.cell >= k.cut AND k.cut < 16777216),
y AS (SELECT n.source, n.cell, n.doc_id FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source AND n.cell = r.cell AND n.doc_id IS NOT DISTINCT FROM r.doc_id AND r.p > 0
      WHERE n.nth = 1 GROUP BY n.source, n.cell, n.doc_id, n.rest HAVING abs(n.rest - sum(r.size)) < n.rest)
SELECT c.doc_id, c.size, c.source_size, c.target,
       (c.size * (c.whole + CASE WHEN c.cell < coalesce(k.cut, 0) OR y.cell IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN k ON c.source IS NOT DISTINCT FROM k.source
LEFT JOIN y ON c.source IS NOT DISTINCT FROM y.source AND c.cell = y.cell AND c.doc_id IS NOT DISTINCT FROM y.doc_id
"""
