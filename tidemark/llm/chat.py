r"""Chat formatting by a grammar that is read back: what a template renders, its parser returns turn by turn.

    conversation := turn*
    turn         := "<s>" body "</s>"
    body         := "[INST] " text " [/INST]"                     a user's
                  | "<<SYS>>\n" text "\n<</SYS>>"                 the system's
                  | "[ROLE]" role "[/ROLE]" text                  any other role's
                  | text                                          an assistant's

A conversation is rendered as it is and parsed; where the turns that come back are not the source's, those that differ
get their control strings escaped, and where they still aren't, all do.  A control string is escaped by
a backslash after its first character (one more where backslashes stand there already), which the
parser takes away again.  No control string stands in escaped text and none can arise where it meets a marker, so the
last round makes every conversation come back; ``round_trips`` tells that it has.

The rendered text is a list of segments, of which those with ``loss`` are the assistants' texts: what a model is
trained on.  Everything is column expressions: one shuffle gathers the turns of a conversation.

Defined results: a null role or text is empty; turns stand by ``turn`` (null first), those of one number by role, then text;
rows without a conv_id form one conversation; repeated rows are turns of their own; very long texts and conversations are
formatted whole, as long as a conversation fits a cell (2 GB); columns besides the four are not looked at, whatever their
names; an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What opens and closes a turn, and what each role's body is framed by.
OPEN, CLOSE = "<s>", "</s>"
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>"), "assistant": ("", "")}
ROLE_OPEN, ROLE_CLOSE = "[ROLE]", "[/ROLE]"

#: What follows the first character of a control string, by that character.
_REST = r"(?:<(?=\\{0}(?:/?s>|</?SYS>>))|\[(?=\\{0}/?(?:INST|ROLE)\]))"


def escaped(text: Column) -> Column:
    """With a backslash after the first character of each control string."""
    return F.regexp_replace(text, _REST.format("*"), r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({_REST.format('+')})" + r"\\", "$1")


# -- turns ------------------------------------------------------------------------------------


def turns_of(conversations: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, turns): a conversation's (role, text) in order."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.select(by, F.struct("turn", filled("role"), filled("text")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy(by).agg(ordered.alias("t")).select(by, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


# -- the template -----------------------------------------------------------------------------


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _segments(turn: Column) -> Column:
    """A turn's segments: one of its own for what is learnt from, so a join of all segments is the rendered text."""
    role, text = turn["role"], turn["text"]
    framed = F.concat(F.lit(ROLE_OPEN), role, F.lit(ROLE_CLOSE), text)
    for name, (before, after) in FRAMES.items():
        framed = F.when(role == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(framed)
    learnt = F.array(_segment(F.lit(OPEN), False), _segment(text, True), _segment(F.lit(CLOSE), False))
    return F.when(role == "assistant", learnt).otherwise(F.array(_segment(F.concat(F.lit(OPEN), framed, F.lit(CLOSE)), False)))


def rendered(turns: Column) -> Column:
    """The segments (text, loss) of all turns."""
    return F.flatten(F.transform(turns, _segments))


def joined(segments: Column) -> Column:
    """The text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


# -- the parser -------------------------------------------------------------------------------


def parsed(text: Column) -> Column:
    """The turns (role, text) that a rendered text holds; what stands behind the last close is a turn of its own."""
    pieces = F.split(text, CLOSE)
    return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: _turn(F.when(p.startswith(OPEN), F.substr(p, F.lit(len(OPEN) + 1))).otherwise(p)))


def _turn(body: Column) -> Column:
    """One turn from what stands between its open and its close."""
    named = body.startswith(ROLE_OPEN) & body.contains(ROLE_CLOSE)
    at = F.instr(body, ROLE_CLOSE)
    role, text = F.when(named, F.substr(body, F.lit(len(ROLE_OPEN) + 1), at - len(ROLE_OPEN) - 1)), F.when(named, F.substr(body, at + len(ROLE_CLOSE)))
    role, text = F.coalesce(role, F.lit("assistant")), F.coalesce(text, body)
    for name, (before, after) in FRAMES.items():
        if before:
            framed = body.startswith(before) & body.endswith(after) & (F.length(body) >= len(before) + len(after))
            inner = F.substr(body, F.lit(len(before) + 1), F.length(body) - len(before) - len(after))
            role, text = F.when(framed, name).otherwise(role), F.when(framed, inner).otherwise(text)
    return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))


# -- the round trip ---------------------------------------------------------------------------


def _escaped_turn(turn: Column) -> Column:
    return F.struct(escaped(turn["role"]).alias("role"), escaped(turn["text"]).alias("text"))


def formatted(conversations: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, segments): every conversation rendered so that its parse is its turns."""
    out = turns_of(conversations, by)
    same = F.col("back") == F.col("turns")
    out = out.withColumn("back", parsed(joined(rendered(F.col("turns")))))
    # A turn that has come back in its place stays as it is.
    differing = F.transform("turns", lambda turn, i: F.when(F.try_element_at("back", i + 1).eqNullSafe(turn), turn).otherwise(_escaped_turn(turn)))
    out = out.select(by, "turns", F.when(same, F.col("turns")).otherwise(differing).alias("sent"))
    # Pieces of one turn can look like another one in its place: such a conversation is escaped as a whole.
    out = out.withColumn("back", parsed(joined(rendered(F.col("sent")))))
    out = out.select(by, F.when(same, F.col("sent")).otherwise(F.transform("turns", _escaped_turn)).alias("sent"))
    return out.select(by, rendered(F.col("sent")).alias("segments"))


def read_back(output: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, turns, loss_text, formatted_chars) of formatted conversations (by, segments)."""
    text = output.select(by, "segments", joined(F.col("segments")).alias("text"))
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return text.select(by, parsed(F.col("text")).alias("turns"), F.array_join(learnt, "").alias("loss_text"), F.length("text").cast("long").alias("formatted_chars"))


def turn_digest(turns: Column) -> Column:
    """SHA-256 in hex of role, line feed, text and line feed of each turn."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)


def round_trips(conversations: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, same, escaped): whether a conversation comes back as it is, and whether anything in it was escaped."""
    source = turns_of(conversations, by)
    back = formatted(conversations, by)
    both = source.join(back.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    text = joined(F.col("segments"))
    return both.select(by, (parsed(text) == F.col("turns")).alias("same"), (joined(rendered(F.col("turns"))) != text).alias("escaped"))
