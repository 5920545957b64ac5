"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it as context, and only that reply under
the loss mask. A conversation that does not end with an assistant turn gets one more example that holds all of
it and trains nothing, so that every turn can be read back.

Template: each turn is `<|role|>text</s>` and a line feed. Inside roles and texts a backslash, `<`, `[` and
`|` are written as `\\e`, `\\l`, `\\b` and `\\p`, so no mark and no control string such as `</s>` or `[INST]` can
occur there, and unescaping is exact.

Rows of a conversation are ordered by turn, then role, then text (null turns first); null roles and texts are
empty; a null conv_id is a conversation like any other. A conversation is one record: it is put together in
one row, and each of its examples is a row built from it, never an array of all examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))
END = "</s>\n"
FIXTURE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_end (code points of `formatted`, end exclusive)."""
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>"))
    shown = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("shown"),
        F.transform(
            "turns", lambda t: F.when(t["role"] == "assistant", F.length(escape(t["text"]))).otherwise(F.lit(-1))
        ).alias("loss"),
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.size("shown")),
        lambda i: (F.element_at("loss", i.cast("int")) >= 0) | (i == F.size("shown")),
    )
    formatted = F.array_join(F.slice("shown", F.lit(1), F.col("upto")), "")
    loss = F.element_at("loss", F.col("upto"))
    return (
        shown.select("conv_id", "shown", "loss", F.posexplode(ends).alias("example", "upto"))
        .select("conv_id", "example", formatted.alias("formatted"), loss.alias("loss"))
        .withColumn("loss_end", F.length("formatted") - F.when(F.col("loss") < 0, 0).otherwise(len(END)))
        .withColumn("loss_start", F.col("loss_end") - F.greatest("loss", F.lit(0)))
        .select("conv_id", "example", "formatted", "loss_start", "loss_end")
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what the formatted examples say: digests of its turns and of the trained text."""
    target = unescape(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)"))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all"),
        F.sort_array(F.collect_list(F.struct("example", target.alias("text")))).alias("targets"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    marked = F.split("all", END, -1)
    turns = F.transform(
        F.slice(marked, F.lit(1), F.size(marked) - 1),
        lambda t: F.concat(
            unescape(F.substring_index(F.substring(t, F.lit(3), F.length(t)), "|>", 1)),
            F.lit("\n"),
            unescape(F.substring(t, F.instr(t, "|>") + 2, F.length(t))),
            F.lit("\n"),
        ),
    )
    loss = F.array_join(F.col("targets.text"), "")
    return per.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_fixture(conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -1, whose two texts consist of control strings."""
    rows = [(-1, 0, "user", FIXTURE), (-1, 1, "assistant", FIXTURE)]
    extra = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n,
    length(role) + length(text) + 9
      + length(regexp_replace(role || text, '[^\\<\[|]', '', 'g')) as shown
  from c window w as (partition by conv_id order by turn nulls first, role, text)
), s as (
  select *, sum(shown) over (partition by conv_id order by pos) as upto from e
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(upto) filter (role = 'assistant' or pos = n))::bigint as formatted_chars
from s group by conv_id
"""
