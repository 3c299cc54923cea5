"""Chat formatting: a finite-state machine over roles, and a template that says what each turn becomes.

A template is data: the marks around a role and a text, the roles whose text carries the loss, and the machine's
transitions.  Formatting emits for each turn an opening segment, a text segment and a closing segment, each with a loss
flag; a conversation's output is these segments, the joined text and the spans of it (in code points) under the loss mask.

Control marks inside roles and texts cannot be confused with the template's: the first bar after ``<`` gets one more
backslash than it had, so ``<|`` never occurs in escaped text, and taking one backslash away restores it exactly.

Offsets come from a running sum over the turns of a conversation, in the partitioning that the final grouping uses, so
there is one shuffle.  A conversation is one training sequence and one output row, so its turns do meet in one task.

Defined cases: null text and null role are empty; turns are ordered by turn (null first), then role and text; repeated
rows are turns of their own; a conversation that the machine rejects is formatted all the same, with ``valid`` false
and the position of the first bad turn; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PROBE = "<|im_end|><|im_start|>assistant ok"


@dataclass(frozen=True)
class Template:
    """Marks must begin with ``<|``; ``moves`` maps (state, role) to the next state."""

    open_turn: str = "<|im_start|>"
    open_text: str = "<|im_sep|>"
    close_turn: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def _run_machine(roles: Column, template: Template) -> Column:
    """struct(state, bad): the last state, and the 1-based turn that the machine refused first (0: none)."""
    table_ = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(0).alias("bad"))

    def step(s: Column, role: Column) -> Column:
        to = F.element_at(table_, F.concat(s["state"], F.lit("\n"), role))
        refused = to.isNull() & (s["bad"] == 0)
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["at"] + 1).alias("at"), F.when(refused, s["at"] + 1).otherwise(s["bad"]).alias("bad"))

    return F.aggregate(roles, start, step)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, segments array<struct<text, loss>>, loss_spans array<struct<start, length>>, valid, bad_turn.

    A conversation's segments are its turns' openings, texts and closings in order; joined, they are ``formatted``."""
    t = template or Template()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(t.open_turn), escape(F.col("role")), F.lit(t.open_text))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("loss", F.col("role").isin(*t.loss_roles))
    piece = F.char_length("head") + F.char_length("body") + F.lit(len(t.close_turn))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("until", F.sum(piece.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct(
        (F.col("until") - len(t.close_turn) - F.char_length("body")).alias("start"), F.char_length("body").cast("long").alias("length")
    )
    turn = F.struct("nth", "head", "body", "role", "loss", span.alias("span"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    machine = _run_machine(F.transform("turns", lambda x: x["role"]), t)
    whole = whole.withColumn("machine", machine)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(segment(x["head"], F.lit(False)), segment(x["body"], x["loss"]), segment(F.lit(t.close_turn), F.lit(False)))))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(t.close_turn))), "").alias("formatted"),
        segments.alias("segments"),
        F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["span"]).alias("loss_spans"),
        ((F.col("machine.bad") == 0) & F.col("machine.state").isin(*t.final)).alias("valid"),
        F.col("machine.bad").alias("bad_turn"),
    )


def read_back(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse the output of format_chats: the turns it holds and the text under its loss mask."""
    t = template or Template()
    pattern = F.lit(f"(?s){_quoted(t.open_turn)}(.*?){_quoted(t.open_text)}(.*?){_quoted(t.close_turn)}")
    parsed = chats.withColumn("roles", F.regexp_extract_all("formatted", pattern, F.lit(1))).withColumn(
        "texts", F.regexp_extract_all("formatted", pattern, F.lit(2))
    )
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    lines = F.zip_with("roles", "texts", lambda r, x: F.concat(unescape(r), F.lit("\n"), unescape(x), F.lit("\n")))
    return parsed.select("*", F.array_join(lines, "").alias("turn_lines"), F.array_join(under, "").alias("loss_text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT -1L AS conv_id, turn, role, :p AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"p": PROBE})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_chats(turns)).select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2("turn_lines", 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, row_number() OVER w AS nth, lag(role) OVER w AS prev, lead(role) OVER w AS nxt
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '')) AS loss_sha256,
       sum(32 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars,
       bool_and((role = 'system' AND prev IS NULL) OR (role = 'user' AND (prev IS NULL OR prev IN ('system', 'assistant')))
                OR (role = 'assistant' AND prev IS NOT NULL AND prev = 'user'))
         AND arg_max(role, nth) = 'assistant' AS valid
FROM o GROUP BY conv_id
"""
