"""Chat formatting that is checked by reading it back.

A turn is written as ``### role: text</turn>`` and a line end. A parser splits
the output at the end marks, takes the role up to the first colon and blank, and
undoes escapes. Every turn is first rendered as it is and parsed; only where the
parser does not return the turn is its content escaped: backslashes are
doubled, end marks lose their form (``<\\/turn>``), and colons in roles become
``<\\c>``. After that no end mark and no header end can stand in the content, and
undoing the three steps backwards restores it, so one round is enough.

Only Spark expressions are used. A conversation is one output string, so its
turns meet in one row; conversations are spread over all tasks.

Defined results: rows of a conversation are sorted by turn, role and text, a
missing turn first; repeated rows are turns of their own; missing role or text
is empty; rows without ``conv_id`` form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenara.llm.quality_rules import let

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
END, HIDDEN_END, HIDDEN_COLON = "</turn>", "<\\/turn>", "<\\c>"


def swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return swap(swap(text, "\\", "\\\\"), END, HIDDEN_END)


def escape_role(role: Column) -> Column:
    return swap(escape(role), ":", HIDDEN_COLON)


def unescape(text: Column) -> Column:
    return swap(swap(swap(text, HIDDEN_COLON, ":"), HIDDEN_END, END), "\\\\", "\\")


def written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(COLON), text, F.lit(CLOSE))


def segments(formatted: Column) -> Column:
    """One part for each turn: header and content as they stand in the output."""

    def cut(part: Column) -> Column:
        head = F.substring_index(part, COLON, 1)
        return F.struct(head.alias("head"), F.substring(part, F.length(head) + len(COLON) + 1, F.length(part)).alias("body"))

    parts = F.split(formatted, CLOSE)
    return F.transform(let(parts, lambda p: F.slice(p, F.lit(1), F.size(p) - 1)), cut)


def parse(formatted: Column) -> Column:
    """The turns of an output string: array of role and text."""
    return F.transform(
        segments(formatted),
        lambda s: F.struct(
            unescape(F.substring(s["head"], len(OPEN) + 1, F.length(s["head"]))).alias("role"),
            unescape(s["body"]).alias("text"),
        ),
    )


def render_turn(turn: Column) -> Column:
    plain = written(turn["role"], turn["text"])
    safe = written(escape_role(turn["role"]), escape(turn["text"]))
    return let(plain, lambda p: F.when(parse(p) == F.array(turn), p).otherwise(safe))


def loss_runs(formatted: Column, role: str) -> Column:
    """The loss mask as run lengths: for each turn the characters left out and
    those under the mask that follow them; the end mark belongs to what is left
    out next."""
    return F.transform(
        segments(formatted),
        lambda s, i: F.struct(
            (F.length(s["head"]) + len(COLON) + F.when(i > 0, len(CLOSE)).otherwise(0)
             + F.when(s["head"] == OPEN + role, 0).otherwise(F.length(s["body"]))).alias("skip"),
            F.when(s["head"] == OPEN + role, F.length(s["body"])).otherwise(0).alias("take"),
        ),
    )


def masked_text(formatted: Column, runs: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    closing = F.lit(len(CLOSE))

    def take(s: Column, i: Column) -> Column:
        run = F.get(runs, i)
        before = run["skip"] - F.when(i > 0, closing).otherwise(0)
        whole = F.concat(s["head"], F.lit(COLON), s["body"])
        return unescape(F.when(run["take"] > 0, F.substring(whole, before + 1, run["take"])).otherwise(""))

    return F.array_join(F.transform(segments(formatted), take), "")


def format_chats(rows: DataFrame, role: str = "assistant") -> DataFrame:
    """``conv_id``, the output ``formatted``, the turns read back from it
    ``recovered``, the mask ``loss_runs``, and ``identical``: the turns read back
    equal the source."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col("turn"), blank("role").alias("role"), blank("text").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("sorted"))
    source = grouped.select("conv_id", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    output = source.withColumn("formatted", F.array_join(F.transform("source", render_turn), ""))
    return output.select(
        "conv_id",
        "formatted",
        parse(F.col("formatted")).alias("recovered"),
        loss_runs(F.col("formatted"), role).alias("loss_runs"),
        (parse(F.col("formatted")) == F.col("source")).alias("identical"),
    )


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what ``format_chats`` gives, all read from the output."""
    spoken = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = chats.withColumn("masked", masked_text(F.col("formatted"), F.col("loss_runs")))
    return masked.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(text).alias("text")) for i, r in enumerate(("user", "assistant"))])
    return spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.*")
