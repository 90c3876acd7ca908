"""Chat formatting in budgeted windows.

A conversation becomes training windows of bounded size.  Prefix sums of the
turns' tokens choose the spans: the token axis is cut into steps; the turns
that lie inside a step form one window, a turn that crosses the border of its
step forms the next.  So windows begin and end with turns, and each fits the
budget unless a single turn does not.  Every window starts with the system
turn, repeats the last turns before it up to a limit, and has under its loss
mask only the assistant turns that are new in it: repeated ones are masked.

Only DataFrame functions.  Positions and prefix sums are made in chunks of a
conversation; windows hold a bounded number of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchwise.llm.common import running_sum, text_of
from branchwise.session import materialize

# The marks of the template, the strings that a text must not
# hold as they are, and the string put into them there.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"

WINDOW_TOKENS = 1024
HISTORY_TOKENS = 256
#: Least tokens of a step, however long the system turn is.
LEAST_STEP = 128
TURN_CHUNK = 512


def escape(text: Column) -> Column:
    """A backslash goes into every control string after its first character;
    one that holds backslashes there already gets one more, so this can be undone."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role is one line: its backslashes and line ends are written out."""
    one_line = F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n")
    return escape(one_line)


def unescape_role(role: Column) -> Column:
    plain = unescape(role)
    return F.regexp_replace(F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: a quarter of its UTF-8 bytes, and four for its marks."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("bigint")


def turns_of(conversations: DataFrame, tokens=turn_tokens) -> DataFrame:
    """Turns with ``pos`` (0, 1, ... by turn, then role and text), prefix sums
    ``begin`` and ``end`` of their tokens, and the conversation's ``key``.

    A null text or role is empty; a null turn comes first; rows without
    conv_id form one conversation; repeated rows are turns of their own.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / TURN_CHUNK), F.lit(-(1 << 62))))
    rows = rows.withColumn("tokens", tokens(F.col("text"))).withColumn("one", F.lit(1).cast("bigint"))
    rows = running_sum(rows, "key", "chunk", ["turn", "role", "text"], "one", "pos")
    rows = running_sum(rows, "key", "chunk", ["pos"], "tokens", "begin")
    return rows.withColumn("end", F.col("begin") + F.col("tokens")).drop("one", "chunk", "turn")


def windows(conversations: DataFrame, window_tokens: int = WINDOW_TOKENS, history_tokens: int = HISTORY_TOKENS,
            tokens=turn_tokens) -> DataFrame:
    """One row per window: conv_id, key, first_pos (of its new turns), ``formatted``,
    ``loss`` (spans of code points in it, end exclusive), ``new_from`` (how many
    turns before the new ones), tokens, over_budget.

    The turn at position 0 is the system turn if its role is ``system``.  A
    turn longer than the budget has a window of its own, whole; an empty table
    has no window.
    """
    turns = materialize(turns_of(conversations, tokens), "chat: turns")
    system = turns.where("pos = 0 AND role = 'system'").select(
        "key", F.col("role").alias("system_role"), F.col("text").alias("system_text"), F.col("tokens").alias("system_tokens"))
    sizes = system.select("key", "system_tokens")
    room = F.greatest(F.lit(window_tokens - history_tokens) - F.coalesce("system_tokens", F.lit(0)), F.lit(LEAST_STEP))
    placed = turns.join(sizes, "key", "left").withColumn("room", room)
    at = F.floor(F.col("begin") / F.col("room"))
    crosses = F.col("end") > (at + 1) * F.col("room")
    placed = placed.withColumn("window", at * 2 + crosses.cast("bigint"))
    spans = materialize(placed.groupBy("key", "window").agg(
        F.min("pos").alias("first_pos"), F.min("begin").alias("window_begin")), "chat: windows")

    new = placed.select("key", "window", "pos", "conv_id", "role", "text", "tokens", F.lit(True).alias("is_new"))
    # A turn is history of the windows that begin between its end and the
    # history limit after its begin: at most two bins of that width.
    bins = lambda c: F.floor(c / history_tokens)
    last = F.col("begin") + history_tokens
    old = turns.where(~((F.col("pos") == 0) & (F.col("role") == "system")) & (F.col("end") <= last)).withColumn(
        "bin", F.explode(F.sequence(bins(F.col("end")), bins(last))))
    history = old.join(spans.withColumn("bin", bins(F.col("window_begin"))), ["key", "bin"]).where(
        F.col("window_begin").between(F.col("end"), last))
    history = history.select("key", "window", "pos", "conv_id", "role", "text", "tokens", F.lit(False).alias("is_new"))
    # The system turn goes before every window that does not begin with it.
    conv = turns.where("pos = 0").select("key", "conv_id")
    first = spans.where("first_pos > 0").join(system, "key").join(conv, "key").select(
        "key", "window", F.lit(0).cast("bigint").alias("pos"), "conv_id", F.col("system_role").alias("role"),
        F.col("system_text").alias("text"), F.col("system_tokens").alias("tokens"), F.lit(False).alias("is_new"))
    parts = new.unionByName(history).unionByName(first)

    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    parts = parts.withColumn("body", escape(F.col("text"))).withColumn("head", F.char_length(head)).withColumn(
        "out", F.concat(head, F.col("body"), F.lit(CLOSE + "\n")))
    before = Window.partitionBy("key", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("from", F.coalesce(F.sum(F.char_length("out")).over(before), F.lit(0)) + F.col("head"))
    span = F.when(F.col("is_new") & (F.col("role") == "assistant"),
                  F.struct(F.col("from").alias("start"), (F.col("from") + F.char_length("body")).alias("end")))
    made = parts.groupBy("key", "window").agg(
        F.first("conv_id").alias("conv_id"),
        F.min(F.when(F.col("is_new"), F.col("pos"))).alias("first_pos"),
        F.sort_array(F.collect_list(F.struct("pos", "out"))).alias("outs"),
        F.sort_array(F.collect_list(span)).alias("loss"),
        F.count(F.when(~F.col("is_new"), 1)).alias("new_from"), F.sum("tokens").alias("tokens"))
    return made.select("conv_id", "key", "first_pos", F.array_join(F.col("outs.out"), "").alias("formatted"), "loss",
                       "new_from", "tokens", (F.col("tokens") > window_tokens).alias("over_budget"))


def read_back(made: DataFrame) -> DataFrame:
    """What the windows say, from ``formatted`` and ``loss`` alone: per window
    ``turns`` (role and text of its new turns) and ``targets`` (the texts
    under its loss mask), both in order and unescaped."""
    # What stands before the first mark is no turn.
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, i: i > F.col("new_from"))

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        end = F.char_length(piece) - F.char_length(role) - 1 - len(CLOSE + "\n")
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(piece, F.char_length(role) + 2, end)).alias("text"))

    return made.withColumn("turns", F.transform(pieces, turn)).withColumn("targets", F.transform(
        "loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, from its windows in order: the number of turns and a
    digest of roles and texts, and length and digest of all target texts.  The
    digest of a conversation needs its texts in one place, as its value does."""
    read = read_back(made).select(
        "conv_id", "key", "first_pos", F.char_length("formatted").alias("chars"), F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("target"))
    whole = read.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"), F.sort_array(F.collect_list(F.struct("first_pos", "said", "target"))).alias("w"))
    said, target = F.array_join("w.said", ""), F.array_join("w.target", "")
    return whole.select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.char_length(target).cast("bigint").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"),
                        F.col("formatted_chars").cast("bigint").alias("formatted_chars"), "n_windows")
