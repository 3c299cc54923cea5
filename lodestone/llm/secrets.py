"""Secret scans: keyword and prefix patterns, and sliding-window Shannon entropy over candidate strings.

The base kinds are leftmost non-overlapping matches of a pattern, kept if long enough.  Candidate strings (20 or more of
the base64url alphabet) are scanned with a window of 20 characters whose counts are incremental: the state holds a count
for each character of the alphabet and one for each class, which the entering and the leaving character change, and the sum
of ``c * log2(c)`` over the counts follows from theirs alone.  A window has the narrowest class that holds all its characters
(digits, hex digits, letters, the whole alphabet), and is hot at or above that class's threshold.  Windows that overlap a base
span do not count.  Each maximal run of hot windows that overlap or touch is a span, unless an allow-list pattern, anchored
at the start or the end of the run's own text, suppresses it.

Spark's functions give matches but not places, so a match's place is the running sum of the lengths of the pieces that
splitting by the same pattern leaves, and of the matches, before it.  That sum, the base spans around a window and the runs
are windows over the events of one row, all after one shuffle by row; rows without a match pass as one narrow row.  Long
candidates are scanned in stretches of STRETCH windows.

Defined cases: null and empty texts have no spans; every input row gives a row, repeated rows too; offsets are code points,
ends exclusive; spans at one start are in the order of kinds; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: kind -> (pattern, group whose length counts, its least length).  Order is the order of kinds at equal starts.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),  # the maximal runs of 24 or more are the long matches of [0-9a-f]+
}
DIGITS, HEX_LETTERS = "0123456789", "ABCDEFabcdef"
ALPHABET = DIGITS + HEX_LETTERS + "GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz" + "+/_=-"
LETTERS_UNTIL = len(ALPHABET) - 5
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW, STRETCH = 20, 1000
#: Bits a character, by class: what random strings of the class mostly reach with 20 characters; digits alone never do.
THRESHOLDS = {"hex": 3.0, "letters": 4.1, "base64": 3.9}
#: Texts of a run that look random and are not secrets: words and numbers with marks between them (paths, names, dates), UUIDs,
#: documented examples, and fillers.
ALLOW = (
    r"^[+/_=-]*([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))+[+/_=-]*$",
    r"^[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{4}){1,3}(-[0-9a-fA-F]{0,12})?$",
    r"(?i)examp(l(e(_?k(ey?)?)?)?)?$",
    r"(?i)^(your|my|some)?[_-]?(placeholder|changeme|redacted)",
)
_EVENT = "array<struct<kind:int,gap:int,length:int,value:string>>"


def _matches(text: Column, kind: int, pattern: str, group: int) -> Column:
    """array<struct<kind, gap, length, value>> of all matches; gap is the length of the text since the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("whole"), value.alias("value"))
    rows = F.transform(
        F.filter(pairs, lambda x: x["whole"].isNotNull()),
        lambda x: F.struct(
            F.lit(kind).alias("kind"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["whole"]).alias("length"), x["value"].alias("value")
        ),
    )
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast(_EVENT))


def hot_windows(value: Column, window: int = WINDOW, thresholds: dict[str, float] | None = None) -> Column:
    """Starts (from 0) of the hot windows of a string over ALPHABET.

    The counts are one string: the character at a character's place in ALPHABET has its count as its code.  ``c * log2(c)``
    is in units of 2**-32, so sums neither drift nor depend on where a stretch began.
    """
    limits = thresholds or THRESHOLDS
    scale = 1 << 32
    cost = F.array(*[F.lit(round(c * math.log2(c) * scale) if c else 0).cast("long") for c in range(window + 2)])
    most = {k: F.lit(int((math.log2(window) - bits) * window * scale + 0.5) + 64).cast("long") for k, bits in limits.items()}
    codes = F.transform(F.array_remove(F.split(value, ""), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(
        F.lit("\x01" * len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("hex"), F.lit(0).alias("letters"),
        F.array().cast("array<int>").alias("hot"),
    )

    def count(counts: Column, code: Column) -> Column:
        return F.ascii(F.substring(counts, code, 1)) - 1

    def changed(s: Column, code: Column, by: int) -> list[Column]:
        """The state after one character more (1) or less (-1)."""
        had = count(s["counts"], code)
        put = F.overlay(s["counts"], F.char((had + by + 1).cast("long")), code, F.lit(1))
        one = lambda inside: F.when(inside, F.lit(by)).otherwise(F.lit(0))
        return [
            put.alias("counts"),
            (s["sum"] + F.get(cost, had + by) - F.get(cost, had)).alias("sum"),
            (s["digits"] + one(code <= len(DIGITS))).alias("digits"),
            (s["hex"] + one(code <= len(DIGITS) + len(HEX_LETTERS))).alias("hex"),
            (s["letters"] + one((code > len(DIGITS)) & (code <= LETTERS_UNTIL))).alias("letters"),
            s["hot"].alias("hot"),
        ]

    def scan(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            entered = F.struct(*changed(s, F.get(codes, i), 1))
            full = F.when(i >= window - 1, _hot(entered, i)).otherwise(entered)
            left = F.get(codes, i - (window - 1))
            return F.transform(F.array(full), lambda x: F.when(i >= window - 1, F.struct(*changed(x, left, -1))).otherwise(x))[0]

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["hot"])

    def _hot(s: Column, i: Column) -> Column:
        none = F.lit(-1).cast("long")
        allowed = F.when(s["digits"] == window, none).when(s["hex"] == window, most["hex"]).when(s["digits"] == 0, most["letters"]).otherwise(most["base64"])
        hot = F.when(s["sum"] <= allowed, F.array_append(s["hot"], i - (window - 1))).otherwise(s["hot"])
        return F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), s["digits"].alias("digits"), s["hex"].alias("hex"), s["letters"].alias("letters"), hot.alias("hot"))

    # the one-element arrays evaluate what they hold once
    return F.when(F.char_length(value) >= window, F.flatten(F.transform(F.array(codes), scan))).otherwise(F.array().cast("array<int>"))


def scan_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id and spans array<struct<start, kind, name, end>> in order, for every row of ``docs``."""
    kinds, entropy = [*BASE, "entropy"], len(BASE)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    found = [_matches(F.col("_text"), k, BASE[n][0], BASE[n][1]) for k, n in enumerate(BASE)] + [_matches(F.col("_text"), entropy, CANDIDATE, 0)]
    rows = rows.select("doc_id", "_row", F.posexplode_outer(F.concat(*found)).alias("nth", "m")).select("doc_id", "_row", "nth", "m.*").repartition("_row")
    until = F.sum(F.col("gap").cast("long") + F.col("length")).over(Window.partitionBy("_row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("end", until).withColumn("start", F.col("end") - F.col("length"))
    long_enough = F.lit(False)
    for k, n in enumerate(BASE):
        long_enough = long_enough | ((F.col("kind") == k) & (F.char_length("value") >= BASE[n][2]))
    # events: base spans, and hot windows; a row without any keeps one event without a kind
    stretches = F.when(F.col("kind") == entropy, F.sequence(F.lit(0), F.col("length") - WINDOW, F.lit(STRETCH)))
    cut = placed.select("doc_id", "_row", "kind", "start", "end", long_enough.alias("base"), "value", F.explode_outer(stretches).alias("off"))
    cut = cut.withColumn("value", F.when(F.col("off").isNotNull(), F.expr(f"substring(value, off + 1, {STRETCH + WINDOW - 1})")))
    cut = cut.select("doc_id", "_row", "kind", "start", "end", "base", "off", "value", F.explode_outer(F.when(F.col("off").isNotNull(), hot_windows(F.col("value")))).alias("hot"))
    at = F.col("start") + F.col("off") + F.col("hot")
    events = cut.select(
        "doc_id",
        "_row",
        F.when(F.col("base"), F.col("kind")).when(F.col("hot").isNotNull(), F.lit(entropy)).alias("kind"),
        F.when(F.col("base"), F.col("start")).otherwise(at).alias("start"),
        F.when(F.col("base"), F.col("end")).otherwise(at + WINDOW).alias("end"),
        F.expr(f"substring(value, hot + 1, {WINDOW})").alias("seen"),
    )
    is_base, is_window = F.col("kind") < entropy, F.col("kind") == entropy
    forth, back = (Window.partitionBy("_row").orderBy(*order) for order in (("start", "kind"), (F.desc("start"), F.desc("kind"))))
    before = F.max(F.when(is_base, F.col("end"))).over(forth.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("_after", after).withColumn("_before", before)
    clear = is_window & F.coalesce(F.col("_before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_after") >= F.col("end"), F.lit(True))
    events = events.withColumn("kind", F.when(is_base | clear, F.col("kind")))
    last = F.last(F.when(is_window, F.col("start")), ignorenulls=True).over(forth.rowsBetween(Window.unboundedPreceding, -1))
    events = events.withColumn("_last", last).withColumn("_joins", F.coalesce(is_window & (F.col("start") - F.col("_last") <= WINDOW), F.lit(False)))
    run = F.sum(F.when(~F.col("_joins"), 1).otherwise(0)).over(forth.rowsBetween(Window.unboundedPreceding, 0))
    fresh = F.when(F.col("_joins"), F.expr(f"right(seen, int(start - _last))")).otherwise(F.col("seen"))
    # windows of a run may have base spans of the same row between them only if they do not touch, so base rows stand alone
    runs = events.withColumn("_run", F.when(is_window, run).otherwise(-F.col("start"))).withColumn("_fresh", fresh)
    runs = runs.groupBy("_row", "doc_id", "kind", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_window, F.struct("start", "_fresh")))), lambda x: x["_fresh"]), "").alias("text")
    )
    suppressed = F.lit(False)
    for pattern in allow:
        suppressed = suppressed | F.col("text").rlike(pattern)
    name = F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1).alias("name")
    span = F.when(is_base | (is_window & ~suppressed), F.struct("start", "kind", name, "end"))
    return runs.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("_row")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(name: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["name"] == name)).cast("long")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [_count(n).alias(f"n_{n}") for n in BASE]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


#: The same spans: places by the lengths of pieces and matches, entropies by the engine's own aggregate on each window.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS (
  SELECT rid, 0 AS kind, string_split_regex(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g,
         regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
         regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v FROM d
  UNION ALL SELECT rid, 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT rid, 3, string_split_regex(t, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]+') FROM d),
e AS (SELECT rid, kind, unnest(range(1, len(m) + 1)) AS i, unnest(g[1:len(m)]) AS gap, unnest(m) AS m, unnest(v) AS v FROM x WHERE len(m) > 0),
p AS (SELECT rid, kind, m, v, sum(len(gap) + len(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS fin FROM e),
b AS (SELECT rid, kind, fin - len(m) AS s, fin AS f FROM p WHERE kind < 3 AND len(v) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
c AS (SELECT rid, fin - len(m) AS s, m, unnest(range(0, len(m) - 19)) AS o FROM p WHERE kind = 3 AND len(m) >= 20),
w AS (SELECT rid, s + o AS s, substr(m, (o + 1)::BIGINT, 20) AS w FROM c),
h AS (SELECT rid, s, w FROM w WHERE NOT regexp_full_match(w, '[0-9]+') AND list_aggregate(string_split(w, ''), 'entropy') >=
        CASE WHEN regexp_full_match(w, '[0-9A-Fa-f]+') THEN 3.0 WHEN NOT regexp_matches(w, '[0-9]') THEN 4.1 ELSE 3.9 END - 1e-9),
k AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = h.rid AND b.s < h.s + 20 AND h.s < b.f)),
l AS (SELECT *, lag(s) OVER (PARTITION BY rid ORDER BY s) AS q FROM k),
r AS (SELECT *, sum(CASE WHEN s - q <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS run FROM l),
u AS (SELECT rid, 3 AS kind, min(s) AS s, max(s) + 20 AS f, string_agg(CASE WHEN s - q <= 20 THEN right(w, (s - q)::BIGINT) ELSE w END, '' ORDER BY s) AS w FROM r GROUP BY rid, run),
a AS (
  SELECT rid, kind, s, f FROM b
  UNION ALL SELECT rid, kind, s, f FROM u WHERE NOT (
    regexp_matches(w, '^[+/_=-]*([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))+[+/_=-]*$') OR regexp_matches(w, '^[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{4}){1,3}(-[0-9a-fA-F]{0,12})?$')
    OR regexp_matches(w, '(?i)examp(l(e(_?k(ey?)?)?)?)?$') OR regexp_matches(w, '(?i)^(your|my|some)?[_-]?(placeholder|changeme|redacted)'))),
z AS (SELECT rid, kind, s, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || f AS span FROM a)
SELECT d.doc_id, count(CASE WHEN kind = 0 THEN 1 END) AS n_assign, count(CASE WHEN kind = 1 THEN 1 END) AS n_access, count(CASE WHEN kind = 2 THEN 1 END) AS n_hex,
       sha256(coalesce(string_agg(CASE WHEN kind < 3 THEN span END, ',' ORDER BY s, kind), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN z ON d.rid = z.rid GROUP BY d.rid, d.doc_id
"""
