"""Chat formatting in expressions.

The turns of a conversation are put in order; adjacent turns of one role are
collected as structs, sorted and merged into a block, and blocks likewise into the
conversation, so the work grows with the turns.  A block is written as

    <|im_start|>role<|im_msg|>text<|im_sep|>text..<|im_end|>

Control strings inside roles and texts, of this template and of others, get a
backslash after their first character, and one more where they already had some,
so a text never opens or closes a turn and reading back gives it exactly.

The loss mask is a list of spans of code points: each text of the roles that are
learnt from, as it stands in the output.

Rows are sorted by turn, then role, then text; repeated rows are turns of their
own.  A null role or text is empty, a null turn comes first, and the rows of a
null conversation are one conversation.  Extra columns are ignored; an empty table
gives an empty result.  Long texts are texts like any other.  A conversation is one
row of the output, so its rows meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coloom.llm.common import table

START, MESSAGE, SEPARATOR, STOP = "<|im_start|>", "<|im_msg|>", "<|im_sep|>", "<|im_end|>"
# Control strings of common templates, after their first character.
TAILS = r"\|im_start\|>|\|im_msg\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>"
PLAIN = rf"([<\[])(\\*)({TAILS})"
ESCAPED = rf"([<\[])\\(\\*)({TAILS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted, mask): one row for each conversation; mask: spans (start, end) of the learnt texts."""
    empty = F.lit("")
    turns = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"),
        F.coalesce(F.col(text), empty).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    opens = before.isNull() | (before != F.col("role"))
    named = escape(F.col("role"))
    # What stands before a text: the end of the last block and a new head, or a separator.
    head = F.when(opens, F.concat(F.when(before.isNull(), empty).otherwise(STOP), F.lit(START), named, F.lit(MESSAGE))).otherwise(SEPARATOR)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        turns.withColumn("head", head)
        .withColumn("body", escape(F.col("text")))
        .withColumn("end", F.sum(F.char_length("head") + F.char_length("body")).over(running))
        .withColumn("block", F.sum(opens.cast("int")).over(running))
    )
    # The rows of a conversation are together, so neither grouping moves them again.
    merged = placed.groupBy("conv", "block", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "end", "body"))).alias("turns"))
    whole = merged.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "role", "turns"))).alias("blocks"))
    return whole.select(
        "conv",
        F.array_join(F.transform("blocks", _write), "").alias("formatted"),
        F.flatten(F.transform(F.filter("blocks", lambda b: b["role"].isin(*learnt)), lambda b: F.transform(b["turns"], _span))).alias("mask"),
    )


def _span(t: Column) -> Column:
    return F.struct((t["end"] - F.char_length(t["body"])).alias("start"), t["end"].alias("end"))


def _write(b: Column) -> Column:
    return F.concat(F.lit(START), escape(b["role"]), F.lit(MESSAGE), F.array_join(F.transform(b["turns"], lambda t: t["body"]), SEPARATOR), F.lit(STOP))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, F.lit(r"\Q" + STOP + r"\E"), -1), lambda b: b.startswith(START))

    def read(b: Column) -> Column:
        parts = F.split(F.substring(b, len(START) + 1, 2147483647), r"\Q" + MESSAGE + r"\E", 2)
        texts = F.split(F.get(parts, F.lit(1)), r"\Q" + SEPARATOR + r"\E", -1)
        return F.transform(texts, lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, read))


#: Code points of one piece of a formatted text.
PIECE = 1024


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, one after the other."""
    # A span is read from the pieces that it touches, so a long text is not walked for each span.
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def read(pieces: Column, s: Column) -> Column:
        def part(i: Column) -> Column:
            first = F.greatest(s["start"] - i * PIECE, F.lit(0))
            return F.substring(F.get(pieces, i.cast("int")), (first + 1).cast("int"), (s["end"] - i * PIECE - first).cast("int"))

        touched = F.sequence(F.floor(s["start"] / PIECE), F.floor((s["end"] - 1) / PIECE))
        return F.when(s["end"] > s["start"], unescape(F.array_join(F.transform(touched, part), ""))).otherwise("")

    # Bound as the variable of an outer lambda, the pieces are made once.
    texts = F.transform(F.array(pieces), lambda p: F.transform(mask, lambda s: read(p, s)))
    return F.array_join(F.get(texts, F.lit(0)), "")


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    loss = masked(F.col("formatted"), F.col("mask"))
    turns = turns_of(F.col("formatted"))
    return (
        chat(rows)
        .withColumn("turns", turns)
        .withColumn("loss", loss)
        .select(
            F.col("conv").alias("conv_id"),
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )


_SQL_ESCAPE = PLAIN.replace("'", "''")
OP6_SQL = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS i,
             length(regexp_replace(role, '{_SQL_ESCAPE}', '\1\\\2\3', 'g')) AS role_chars,
             length(regexp_replace(text, '{_SQL_ESCAPE}', '\1\\\2\3', 'g')) AS text_chars
      FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN before IS NULL OR before <> role THEN role_chars + {len(START) + len(MESSAGE) + len(STOP)}
                             ELSE {len(SEPARATOR)} END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
