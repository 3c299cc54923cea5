"""Fill-in-the-middle transformation, as Spark expressions only.

A text becomes an array of units (white space and the word after it, or white space at the end).  A SHA-256 of seed and
doc_id gives four numbers: two cuts between units, and the choices of whether and in which order the parts are written.
Sentinels are fixed strings; a text that holds one stays plain, so the first occurrence of each in an output is the real
one and the output alone, with its form, restores the text.

Everything happens in the row that is read: no shuffle, and no state but the row's own units.

Defined cases: a null text is an empty one and stays plain; a null doc_id counts as the empty string; rows that repeat a
doc_id get the same numbers; an empty table gives no rows; other columns of the input are not returned by
``op13_fill_in_middle``, and ``fill_in_middle`` keeps them and replaces those that it makes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space is taken in one go, so a long run of it at the end of a text is looked at once.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Infill:
    """What is done to a text: ``rate`` and ``suffix_first`` are percentages."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _word(digest: Column, nth: int) -> Column:
    """The nth group of 8 hex digits (from 0) as an unsigned integer."""
    return F.conv(F.substring(digest, 1 + 8 * nth, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(units, start + 1, length), "")


def fill_in_middle(docs: DataFrame, rules: Infill | None = None) -> DataFrame:
    """Rows of ``docs`` plus n (units), form (plain, psm or spm), fim (the output), prefix_chars and middle_chars."""
    r = rules or Infill()
    text = F.coalesce(F.col("text"), F.lit(""))
    held = [c for c in docs.columns if c.lower() not in ("n", "form", "fim", "prefix_chars", "middle_chars")]
    rows = docs.select(
        F.struct(*held).alias("row"),
        F.col("text"),
        F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("_units"),
        F.sha2(F.concat(F.lit(f"{r.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("_digest"),
    )
    rows = rows.withColumn("n", F.size("_units").cast("long"))
    cuts = [_word(F.col("_digest"), i) % (F.col("n") + 1) for i in (0, 1)]
    marked = F.lit(False)
    for s in r.sentinels:
        marked = marked | F.contains(text, F.lit(s))
    plain = (text == "") | marked | (_word(F.col("_digest"), 2) % 100 >= r.rate)
    first = _word(F.col("_digest"), 3) % 100 < r.suffix_first
    rows = rows.withColumn("form", F.when(plain, "plain").when(first, "spm").otherwise("psm"))
    rows = rows.withColumn("_a", F.least(*cuts).cast("int")).withColumn("_b", F.greatest(*cuts).cast("int"))
    cut = F.col("form") != "plain"
    units, a, b = F.col("_units"), F.col("_a"), F.col("_b")
    rows = rows.withColumn("_prefix", F.when(cut, _joined(units, F.lit(0), a))).withColumn("_middle", F.when(cut, _joined(units, a, b - a)))
    rows = rows.withColumn("_suffix", F.when(cut, _joined(units, b, F.col("n").cast("int") - b)))
    head = F.concat(F.lit(r.prefix), "_prefix")
    tail = F.concat(F.lit(r.suffix), "_suffix")
    last = F.concat(F.lit(r.middle), "_middle")
    fim = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(head, tail, last)).otherwise(F.concat(tail, head, last))
    return rows.select(*[F.col("row")[c].alias(c) for c in held], "n", "form", fim.alias("fim"), F.char_length("_prefix").cast("long").alias("prefix_chars"), F.char_length("_middle").cast("long").alias("middle_chars"))


def restore(fim: Column, form: Column, rules: Infill | None = None) -> Column:
    """The text from an output and its form: the parts between the sentinels, in the text's order."""
    r = rules or Infill()
    first = F.when(form == "psm", F.lit(r.prefix)).otherwise(F.lit(r.suffix))
    second = F.when(form == "psm", F.lit(r.suffix)).otherwise(F.lit(r.prefix))
    rest = F.substr(fim, F.char_length(first) + 1)
    one, rest = F.split_part(rest, second, F.lit(1)), F.substr(rest, F.instr(rest, second) + F.char_length(second))
    two, three = F.split_part(rest, F.lit(r.middle), F.lit(1)), F.substr(rest, F.instr(rest, F.lit(r.middle)) + len(r.middle))
    return F.when(form == "plain", fim).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("fim", 256).alias("output_sha256"),
        F.sha2(restore(F.col("fim"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END AS units FROM d),
h AS (SELECT *, len(units)::BIGINT AS n,
             ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
             ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
