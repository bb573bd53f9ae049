r"""Chat formatting with relational operators and Spark expressions only.

A conversation's rows are collected as structs and sorted by turn (ties by role, then text). Adjacent rows of one
role become one block; inside it ``<next>`` parts the rows, so that nothing of the input is lost:

    <turn:user>
    first text<next>second text</turn>
    <turn:assistant>
    answer</turn>

Inside texts ``\`` is written ``\b`` and ``<`` is written ``\l``, so that no control string can stand in a text,
and both are read back in that order's reverse. Roles are written the same way, ``>`` as ``\g`` as well. The loss mask is a list of
character spans, one for each assistant row, that leaves out all markers.

Null texts and roles count as empty; null conversation ids form one conversation, null turns come first. Repeated
rows are turns of their own. An empty table gives an empty result. Other columns of the input are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEXT, END = "<next>", "</turn>\n"
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: ``conv_id``, ``formatted``, ``loss_spans`` (start, length)."""
    safe_role = F.replace(escape(F.coalesce(F.col(role), F.lit(""))), F.lit(">"), F.lit("\\g"))
    item = F.struct(
        F.col(turn).alias("turn"), safe_role.alias("role"), escape(F.coalesce(F.col(text), F.lit(""))).alias("text")
    )
    df = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    # Merge by folding: a row opens a block or joins the last one. Pieces hold what is written and what is learned.
    df = df.withColumn(
        "pieces",
        F.expr(r"""
        transform(turns, (t, i) -> struct(
            case when i = 0 then concat('<turn:', t.role, '>\n')
                 when get(turns, i - 1).role = t.role then '<next>'
                 else concat('</turn>\n<turn:', t.role, '>\n') end as mark,
            t.text as text,
            t.role = 'assistant' as learned))"""),
    )
    df = df.withColumn("formatted", F.expr(r"concat(array_join(transform(pieces, p -> concat(p.mark, p.text)), ''), '</turn>\n')"))
    # Where pieces start: inside chunks of 64 pieces first, then the chunks themselves, so that no array grows by one a piece for long.
    df = df.withColumn("_chunks", F.expr("transform(sequence(0, size(pieces) - 1, 64), i -> slice(pieces, i + 1, 64))"))
    df = df.withColumn("_starts", F.expr(_running("_chunks", "aggregate(c, 0L, (n, p) -> n + length(p.mark) + length(p.text))")))
    df = df.withColumn(
        "loss_spans",
        F.expr(f"""
        flatten(transform(_chunks, (c, i) -> filter(
          zip_with(c, {_running("c", "length(c.mark) + length(c.text)")},
                   (p, at) -> struct(get(_starts, i) + at + length(p.mark) as start, cast(length(p.text) as bigint) as len, p.learned as learned)),
          s -> s.learned)))"""),
    )
    return df.select("conv_id", "formatted", F.expr("transform(loss_spans, s -> struct(s.start as start, s.len as len))").alias("loss_spans"))


def _running(items: str, size: str) -> str:
    """SQL: for each of ``items`` the sum of the sizes (of an item ``c``) before it."""
    return f"""aggregate({items}, named_struct('at', 0L, 'out', cast(array() as array<bigint>)),
        (a, c) -> named_struct('at', a.at + {size}, 'out', array_append(a.out, a.at))).out"""


def parse(formatted: DataFrame) -> DataFrame:
    """Read turns and learned texts back from the output: ``turns`` (role, text) and ``learned`` (texts)."""
    blocks = F.expr(r"filter(split(formatted, '</turn>\n'), b -> b != '')")
    df = formatted.withColumn("_blocks", blocks)
    df = df.withColumn(
        "turns",
        F.expr(r"""
        flatten(transform(_blocks, b -> transform(
            split(substring(b, instr(b, '>\n') + 2), '<next>'),
            x -> struct(replace(replace(replace(substring(b, 7, instr(b, '>\n') - 7), '\\g', '>'), '\\l', '<'), '\\b', '\\') as role,
                        replace(replace(x, '\\l', '<'), '\\b', '\\') as text))))"""),
    )
    df = df.withColumn(
        "learned",
        F.expr(r"transform(loss_spans, s -> replace(replace(substring(formatted, cast(s.start + 1 as int), cast(s.len as int)), '\\l', '<'), '\\b', '\\'))"),
    )
    return df.withColumn("n_blocks", F.size("_blocks").cast("long")).drop("_blocks")
