r"""Chat formatting with a grammar round trip.

A conversation is rendered as a header line and one frame per turn:

    <|chat|>LEVEL
    <|turn|>ROLE
    TEXT<|end|>

A deterministic parser reads the frames back; a frame with ``<|`` inside its role or text is malformed. If what it
recovers is not the source, the conversation is rendered anew at the next level, at which roles and texts are escaped:
a backslash becomes ``\s``, ``<|`` becomes ``<\p``, a line feed in a role ``\n``. Every backslash of an escaped text starts
one of these pairs, so they can be undone by plain replacement. The round trip is checked at each level, and a
conversation that fails at the last one (which none should) stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
HEADER, TURN, END, OPENER = "<|chat|>", "<|turn|>", "<|end|>\n", "<|"
END_PATTERN = r"<\|end\|>\n"
LEVELS = (0, 1)


def _escape(text: Column, level: int) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p")) if level else text


def _unescape(text: Column, level: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|"))
    return F.when(level > 0, F.replace(plain, F.lit("\\s"), F.lit("\\"))).otherwise(text)


def render(turns: Column, level: int) -> Column:
    """``turns``, an array of (role, text), as one string."""

    def frame(turn: Column) -> Column:
        role = _escape(turn["role"], level)
        role = F.replace(role, F.lit("\n"), F.lit("\\n")) if level else role
        return F.concat(F.lit(TURN), role, F.lit("\n"), _escape(turn["text"], level), F.lit(END))

    return F.concat(F.lit(f"{HEADER}{level}\n"), F.array_join(F.transform(turns, frame), ""))


def level_of(formatted: Column) -> Column:
    return F.substring(formatted, len(HEADER) + 1, 1).cast("int")


def frames_of(formatted: Column) -> Column:
    """The frames of a rendered conversation, without their end marks."""
    parts = F.split(F.substr(formatted, F.lit(len(HEADER) + 3)), END_PATTERN)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse_frame(frame: Column, level: Column) -> Column:
    """(role, text) of a frame, null if it is malformed."""
    rest = F.substr(frame, F.lit(len(TURN) + 1))
    role = F.substring_index(rest, "\n", 1)
    text = F.substr(rest, F.length(role) + 2)
    sound = frame.startswith(TURN) & F.contains(rest, F.lit("\n")) & ~F.contains(rest, F.lit(OPENER))
    return F.when(sound, F.struct(_unescape(role, level).alias("role"), _unescape(text, level).alias("text")))


def parse(formatted: Column) -> Column:
    return F.transform(frames_of(formatted), lambda frame: parse_frame(frame, level_of(formatted)))


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``id_col`` and ``formatted``, its turns in the order of ``turn_col``, then role, then text.

    Null texts and roles count as empty. Rows of null id are one conversation, a null turn comes first, repeated rows are
    repeated turns. Other columns are left out; an empty table gives an empty result. A conversation is one string, so it
    must fit in memory.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.select("id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    chosen = F.raise_error(F.lit("no level of escaping gives the turns back")).cast("string")
    for level in reversed(LEVELS):
        chats = chats.withColumn(f"level{level}", render(F.col("turns"), level))
        formatted = F.col(f"level{level}")
        chosen = F.when(parse(formatted) == F.col("turns"), formatted).otherwise(chosen)
    return chats.select(F.col("id").alias(id_col), chosen.alias("formatted"))


def read_turns(chats: DataFrame, id_col: str = "conv_id", formatted_col: str = "formatted", loss_role: str = "assistant") -> DataFrame:
    """The turns of formatted conversations: ``id_col``, i (from 0), role, text, and the place of the escaped text.

    ``start`` (from 1) and ``length`` are in code points of the formatted string; ``in_loss`` marks the turns of
    ``loss_role``, whose texts are what a model is trained on.
    """
    level = level_of(F.col(formatted_col))
    frames = chats.select(F.col(id_col).alias("id"), level.alias("level"), F.posexplode(frames_of(F.col(formatted_col))).alias("i", "frame"))
    before = F.sum(F.length("frame") + len(END)).over(Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    frames = frames.withColumn("before", F.coalesce(before, F.lit(0)) + len(HEADER) + 2).withColumn("turn", parse_frame(F.col("frame"), F.col("level")))
    head = F.length(F.substring_index("frame", "\n", 1)) + 1
    return frames.select(
        F.col("id").alias(id_col), "i", "turn.role", "turn.text", (F.col("before") + head + 1).alias("start"), (F.length("frame") - head).cast("long").alias("length"),
        (F.col("turn.role") == loss_role).alias("in_loss"),
    )
