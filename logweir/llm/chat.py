"""Operator 10: chat formatting by prefix-target expansion.

Every assistant turn becomes a training example of its own: all turns before it are its
context and only its text is trainable. Turns after the last assistant turn (or all turns,
where there is none) make a last example without a target, so no turn is lost.

The template of a turn is ``### Role:`` and a line end, the text, ``</turn>`` and a line end.
Inside texts and roles three strings are escaped, each to a two-character code: the backslash
to ``\\b``, ``###`` to ``\\h`` and ``</turn>`` to ``\\e``; in roles the line end also becomes
``\\n``. After escaping every backslash begins a code, so the codes are undone one after the
other, the backslash last.

Defined cases: a null text is an empty text and a null role an empty role (not an assistant);
null turns come first; turns of the same number are ordered by role, then text, and repeated
rows stay repeated; rows with a null conversation id form one conversation; an empty table
gives an empty table; other columns are ignored. A conversation is one row of turns: an
example holds it whole. Expanding n assistant turns makes n texts, each no longer than the
conversation, one at a time. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import let, table

ASSISTANT = "assistant"
END = "</turn>"
#: What is escaped in texts, and its codes, in the order of escaping.
CODES = (("\\", "\\b"), ("###", "\\h"), (END, "\\e"))
LINE_CODE = ("\n", "\\n")


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _head(role: Column) -> Column:
    shown = F.replace(escape(role), F.lit(LINE_CODE[0]), F.lit(LINE_CODE[1]))
    return F.concat(F.lit("### "), shown, F.lit(":\n"))


def _role(head: Column) -> Column:
    shown = F.replace(head, F.lit(LINE_CODE[1]), F.lit(LINE_CODE[0]))
    return unescape(shown)


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), last, text, loss_start and loss_length (code points).

    ``text`` is the formatted context and target. The loss mask covers ``loss_length`` code
    points from ``loss_start``: the target's escaped text, without its header and end mark;
    the length is null in an example without a target.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(F.col("turns"), i - 1)["role"] == ASSISTANT)
    tail = F.when(F.get(F.col("turns"), n - 1)["role"] == ASSISTANT, F.array().cast("array<int>")).otherwise(F.array(n))
    body = lambda t: F.concat(_head(t["role"]), escape(t["text"]), F.lit(END + "\n"))
    parts = whole.select(
        "conv_id", n.alias("n"), F.transform("turns", body).alias("parts"), "turns", F.concat(replies, tail).alias("ends")
    )
    each = parts.select("conv_id", "n", "parts", "turns", F.posexplode("ends").alias("example", "end"))
    final = F.get(F.col("turns"), F.col("end") - 1)
    context = F.array_join(F.slice("parts", F.lit(1), F.col("end") - 1), "")
    last_part = F.get(F.col("parts"), F.col("end") - 1)
    trainable = final["role"] == ASSISTANT
    return each.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("end") == F.col("n")).alias("last"),
        F.concat(context, last_part).alias("text"),
        F.when(trainable, F.length(context) + F.length(_head(final["role"]))).cast("long").alias("loss_start"),
        F.when(trainable, F.length(escape(final["text"]))).cast("long").alias("loss_length"),
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    cut = F.split(text, F.lit(END + "\n"))
    parts = F.slice(cut, F.lit(1), F.size(cut) - 1)

    def turn(part: Column) -> Column:
        at = F.locate(":\n", part)
        head = F.substr(part, F.lit(5), at - 5)
        return F.struct(_role(head).alias("role"), unescape(F.substr(part, at + 2)).alias("text"))

    return F.transform(parts, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the examples of each conversation say, parsed from their texts and loss masks.

    The last example has all turns; every other gives only its target, so what is shuffled
    stays in proportion to the input.
    """
    digest = lambda ts: F.sha2(
        F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
    )
    seen = formatted.select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("chars"),
        F.when(
            F.col("last"),
            let(read_turns(F.col("text")), lambda ts: F.struct(F.size(ts).cast("long").alias("n"), digest(ts).alias("sha"))),
        ).alias("all"),
        F.when(
            F.col("loss_length").isNotNull(),
            F.struct(
                "example", unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_length"))).alias("text")
            ),
        ).alias("loss"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"]), "")
    return (
        seen.groupBy("conv_id")
        .agg(F.max("all").alias("all"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            F.col("all.n").alias("n_turns"),
            F.col("all.sha").alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


#: A conversation whose texts hold the template's own control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return read_back(examples(rows.unionByName(probe)))


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), chr(10), '\n'))
             + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) + 14 AS chars
      FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
