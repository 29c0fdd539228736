r"""Chat formatting by Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role share a block, and blocks
are concatenated::

    ### user:
    first text<more>second text</turn>
    ### assistant:
    answer</turn>

Control strings inside texts are escaped reversibly: ``\`` becomes ``\\``, ``</turn>`` ``\l/turn>``, ``<more>``
``\lmore>`` and ``### `` ``\h## ``; in roles ``:`` becomes ``\c`` as well. The loss mask is run-length encoded: lengths
of what alternately stays out of and goes into the loss, in code points; only texts of the assistant go in.

Defined cases: null roles and texts are empty ones; turns are ordered by turn (null first), role and text, so ties and
repeated rows have one order; a null conversation id is a conversation of its own; only the four named columns are read;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
HEAD, ROLE_END, MORE, TURN_END = "### ", ":\n", "<more>", "</turn>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), (TURN_END, "\\l/turn>"), (MORE, "\\lmore>"), (HEAD, "\\h## ")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def unescaped(text: Column) -> Column:
    """Doubled backslashes are set aside first, so that what they precede is not taken for an escape."""
    def signs(part: Column) -> Column:
        for safe, plain in (("\\l", "<"), ("\\h", "#"), ("\\c", ":")):
            part = F.replace(part, F.lit(safe), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), signs), "\\")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_runs): loss_runs lists lengths, the first outside the loss, and they add up to the
    length of ``formatted``."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def piece(t: Column, i: Column) -> Column:
        """What stands before a turn's text, the text, and whether it counts."""
        joined = (i > 0) & (F.get("ts", i - 1)["role"] == t["role"])
        before = F.concat(F.when(i > 0, F.lit(TURN_END + "\n")).otherwise(F.lit("")), F.lit(HEAD), escaped_role(t["role"]), F.lit(ROLE_END))
        return F.struct(F.when(joined, F.lit(MORE)).otherwise(before).alias("before"), escaped(t["text"]).alias("text"),
                        (t["role"] == ASSISTANT).alias("loss"))

    pieces = sorted_.select("conv_id", F.transform("ts", piece).alias("ps"))
    close = F.lit(TURN_END + "\n")
    shown = F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["before"], p["text"])), ""), close)
    runs = F.flatten(F.transform("ps", lambda p: F.array(
        F.length(p["before"]) + F.when(p["loss"], 0).otherwise(F.length(p["text"])),
        F.when(p["loss"], F.length(p["text"])).otherwise(0))))
    return pieces.select("conv_id", shown.alias("formatted"), F.concat(runs, F.array(F.length(close))).alias("loss_runs"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    def turns(block: Column) -> Column:
        head = F.substring_index(block, ROLE_END, 1)
        role = unescaped(F.substr(head, F.lit(len(HEAD) + 1)))
        body = F.substr(block, F.length(head) + F.lit(len(ROLE_END) + 1))
        return F.transform(F.split(body, MORE, -1), lambda part: F.struct(role.alias("role"), unescaped(part).alias("text")))

    blocks = F.split(formatted, TURN_END + "\n", -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns))


def digest(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)


def under_mask(formatted: Column, loss_runs: Column) -> Column:
    """The pieces of the formatted text that lie under the mask, unescaped, one for each run that goes into the loss."""
    # Code points are cut as four bytes each, so that a place far inside a long text is reached at once.
    wide, turns = F.encode(formatted, "UTF-32"), (F.size(loss_runs) / 2).cast("int")
    run = lambda i: F.get(loss_runs, i)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        F.sequence(F.lit(0), turns - 1), begin, lambda done, i: F.struct(
            (done["at"] + run(2 * i) + run(2 * i + 1)).alias("at"), F.array_append(done["starts"], done["at"] + run(2 * i)).alias("starts")),
        lambda done: done["starts"])
    pieces = F.transform(starts, lambda start, i: F.when(run(2 * i + 1) > 0, F.substring(wide, 4 * start + 1, 4 * run(2 * i + 1))))
    return F.transform(F.filter(pieces, lambda p: p.isNotNull()), lambda p: unescaped(F.decode(p, "UTF-32")))
