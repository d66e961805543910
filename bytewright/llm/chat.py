"""Chat formatting in Spark expressions: sort, merge neighbours of one role, escape, concatenate, and read back.

A conversation becomes blocks ``<|turn|>role<|text|>text<|more|>text<|end|>``: neighbouring turns of one role share a block,
their texts set apart by ``<|more|>``. Roles and texts are escaped: a backslash is doubled, and one is put after the first
character of every control string, so that no control string is left in them and taking away one backslash before each
character undoes it.

Beside the formatted text stands its loss mask, as spans of code points: the assistant's texts, and nothing between them. What is read
back comes from these two alone. One shuffle by conversation; a conversation is one row, as its formatted text is, and of any
length, with work in proportion to it.

Defined cases: a null text or role is as empty, and an empty assistant's text has an empty span; turns that tie are ordered by role and
text, null turns first; repeated rows are turns of their own; rows with a null conv_id form one conversation; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
#: Beginnings or whole control strings of this and other templates; each gets a backslash after its first character.
CONTROLS = ["<|", "|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    """``text`` without control strings, reversibly."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROLS, out)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame, assistant: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss)``: the text, and the mask as ``(start, end)`` spans in order, the end exclusive."""
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    turns = turns.withColumn("t", F.struct("t.turn", "t.role", "t.text", escape(F.col("t.text")).alias("escaped")))
    conversations = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def segments(t: Column) -> Column:
        last = F.size(t) - 1

        def opens(i: Column) -> Column:
            return (i == 0) | (t[F.greatest(i - 1, F.lit(0))]["role"] != t[i]["role"])

        def closes(i: Column) -> Column:
            return (i == last) | (t[F.least(i + 1, last)]["role"] != t[i]["role"])

        def plain(text: Column) -> Column:
            return F.struct(text.alias("text"), F.lit(False).alias("loss"))

        def parts(x: Column, i: Column) -> Column:
            head = F.when(opens(i), F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT))).otherwise(F.lit(MORE))
            text = F.struct(x["escaped"].alias("text"), (x["role"] == assistant).alias("loss"))
            return F.when(closes(i), F.array(plain(head), text, plain(F.lit(END)))).otherwise(F.array(plain(head), text))

        return F.flatten(F.transform(t, parts))

    def output(parts: Column) -> Column:
        def masked(starts: Column) -> Column:
            spans = F.zip_with(parts, starts, lambda s, at: F.struct(at.alias("start"), (at + F.length(s["text"])).alias("end"), s["loss"].alias("loss")))
            return F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))

        lengths = F.transform(parts, lambda s: F.length(s["text"]).cast("bigint"))
        return F.struct(F.array_join(F.transform(parts, lambda s: s["text"]), "").alias("formatted"), let(running(lengths), masked).alias("loss"))

    return conversations.select("conv_id", let(let(F.col("t"), segments), output).alias("o")).select("conv_id", "o.*")


def parse(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted text."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        def of(x: Column) -> Column:
            texts = F.split(F.regexp_replace(x[1], r"<\|end\|>", ""), r"<\|more\|>", -1)
            return F.transform(texts, lambda t: F.struct(unescape(x[0]).alias("role"), unescape(t).alias("text")))

        return let(F.split(block, r"<\|text\|>", -1), of)

    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted text and its mask."""

    def masked(chars: Column) -> Column:
        return F.array_join(F.transform("loss", lambda s: unescape(F.array_join(F.slice(chars, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), ""))), "")

    read = formatted.select(
        "conv_id",
        parse(F.col("formatted")).alias("turns"),
        let(F.split("formatted", ""), masked).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    return reduce(lambda c, s: f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')", CONTROLS, out)


#: The same digests, with the formatted length as a sum, for DuckDB.
SQL = f"""
with a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b as (select *, row_number() over w as k, lag(role) over w as before from a window w as (partition by conv_id order by turn nulls first, role, text)),
c as (select *, case when before is null or before <> role then {len(TURN) + len(TEXT) + len(END)} + length({_sql_escape("role")}) else {len(MORE)} end
  + length({_sql_escape("text")}) as n from b)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n)::bigint as formatted_chars
from c group by conv_id
"""
