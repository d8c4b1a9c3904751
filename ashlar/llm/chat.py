"""Chat formatting by grammar round trip, with DataFrame functions only.

Each conversation becomes one text.  A turn is written with markers of its role, the texts are first
written as they are, and the result is read back by a deterministic parser (one regular expression).
Where the turns read back differ from the source, conflicting texts are escaped and the
conversation is written and read again: first those texts that hold a marker's first character or an
escape, then, if that were not enough, every text and role.  What is returned is the form that reads
back identically; if none did, the query fails rather than return a conversation that reads otherwise.

The grammar (fixed values):

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    any other  <|role|> role <|text|> text <|end|>

Escapes: ``\\B`` for a backslash, ``\\L`` for ``[`` and ``\\A`` for ``<``; the parser undoes them in any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import _with

USER, USER_END = "[INST] ", " [/INST]"
ASSISTANT, ASSISTANT_END = "<s> ", " </s>"
SYSTEM, SYSTEM_END = "<<SYS>> ", " <</SYS>>"
OTHER, OTHER_TEXT, OTHER_END = "<|role|> ", " <|text|> ", " <|end|>"
#: One turn, markers included.  Lazy runs of any character need no recursion, whatever the text's length.
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|<\|role\|> .*? <\|text\|> .*? <\|end\|>"

#: Turns whose lengths are added up in one step of the loss mask.
BLOCK = 256


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\B"), ("[", "\\L"), ("<", "\\A")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in (("[", "\\L"), ("<", "\\A"), ("\\", "\\B")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _needs_escape(text: Column) -> Column:
    return text.contains("[") | text.contains("<") | text.contains("\\")


def _at_level(level: int, text: Column) -> Column:
    if level == 0:
        return text
    return F.when(_needs_escape(text), escaped(text)).otherwise(text) if level == 1 else escaped(text)


def _parts(level: int, turn: Column) -> list[Column]:
    """Opening, text as written, closing."""
    role, text = turn["role"], _at_level(level, turn["text"])
    pick = lambda user, assistant, system, other: F.when(role == "user", user).when(role == "assistant", assistant).when(role == "system", system).otherwise(other)
    opening = pick(F.lit(USER), F.lit(ASSISTANT), F.lit(SYSTEM), F.concat(F.lit(OTHER), _at_level(level, role), F.lit(OTHER_TEXT)))
    return [opening, text, pick(F.lit(USER_END), F.lit(ASSISTANT_END), F.lit(SYSTEM_END), F.lit(OTHER_END))]


def render(turns: Column, level: int = 0) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(*_parts(level, t))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), escapes undone.  Text outside any turn
    is not lost silently: it comes back as a last turn with the role null."""
    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))

    def between(x: Column, opening: str, closing: str) -> Column:
        return F.substring(x, F.lit(len(opening) + 1), F.length(x) - F.lit(len(opening) + len(closing)))

    def turn(x: Column) -> Column:
        split_at = F.locate(OTHER_TEXT, x)
        role = F.when(x.startswith(USER), F.lit("user")).when(x.startswith(ASSISTANT), F.lit("assistant")).when(x.startswith(SYSTEM), F.lit("system"))
        text = (
            F.when(x.startswith(USER), between(x, USER, USER_END))
            .when(x.startswith(ASSISTANT), between(x, ASSISTANT, ASSISTANT_END))
            .when(x.startswith(SYSTEM), between(x, SYSTEM, SYSTEM_END))
            .otherwise(F.substring(x, split_at + len(OTHER_TEXT), F.length(x) - split_at + 1 - len(OTHER_TEXT) - len(OTHER_END)))
        )
        other = F.substring(x, F.lit(len(OTHER) + 1), split_at - 1 - len(OTHER))
        return F.struct(unescaped(F.coalesce(role, other)).alias("role"), unescaped(text).alias("text"))

    turns = F.transform(found, turn)
    rest = F.length(formatted) - F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))
    return F.when(rest == 0, turns).otherwise(F.concat(turns, F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text")))))


def format_chats(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``formatted`` text, ``turns`` as read back, ``loss_mask`` (array of
    (start, length) in characters from 0, one span per assistant turn) and ``escape_level`` (0, 1 or 2).

    Turns are ordered by turn, then role, then text, so ties and repeated rows have one order; a null turn
    is first, a null role or text is empty, null ids form one conversation.  Other input columns
    do not matter.  An empty table gives an empty table.  One conversation's text is one value, so its turns meet in
    one row; conversations are only ever grouped by their id.
    """
    item = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = df.groupBy(F.col(conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("source"))
    source = grouped.select("conv_id", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    raw = source.withColumn("formatted", render(F.col("source"))).withColumn("turns", parse(F.col("formatted")))
    level = F.when(F.col("turns") == F.col("source"), 0)
    # a branch of CASE is only evaluated for the conversations that need it
    once = raw.withColumn("escape_level", level).withColumn("formatted", F.when(F.col("escape_level") == 0, F.col("formatted")).otherwise(render(F.col("source"), 1)))
    once = once.withColumn("turns", F.when(F.col("escape_level") == 0, F.col("turns")).otherwise(parse(F.col("formatted"))))
    once = once.withColumn("escape_level", F.coalesce("escape_level", F.when(F.col("turns") == F.col("source"), 1)))
    twice = once.withColumn("formatted", F.when(F.col("escape_level").isNotNull(), F.col("formatted")).otherwise(render(F.col("source"), 2)))
    twice = twice.withColumn("turns", F.when(F.col("escape_level").isNotNull(), F.col("turns")).otherwise(parse(F.col("formatted"))))
    same = F.col("escape_level").isNotNull() | (F.col("turns") == F.col("source"))
    final = twice.withColumn("escape_level", F.when(same, F.coalesce("escape_level", F.lit(2))).otherwise(F.raise_error(F.lit("a conversation does not read back as it was written")).cast("int")))
    return final.select("conv_id", "formatted", "turns", loss_mask(F.col("formatted")).alias("loss_mask"), "escape_level")


def _starts(lengths: Column) -> Column:
    """Where each piece starts, from the pieces' lengths (there is one at least): running sums in blocks of ``BLOCK``, so that an
    array is only appended to while it is short and a conversation's cost grows little faster than its turns."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    before = lambda v: F.aggregate(v, empty, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    blocks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK)), lambda i: F.slice(lengths, i, BLOCK))
    whole = lambda v: F.aggregate(v, F.lit(0), lambda s, n: s + n)
    placed = lambda b: F.zip_with(b, before(F.transform(b, whole)), lambda v, at: F.transform(before(v), lambda x: x + at))
    return F.flatten(_with(blocks, placed))


def loss_mask(formatted: Column) -> Column:
    """Spans of the assistants' texts inside a formatted text: array of (start, length), start from 0."""
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def spans(found: Column) -> Column:
        span = lambda x, at: F.when(x.startswith(ASSISTANT), F.struct((at + len(ASSISTANT)).cast("long").alias("start"), (F.length(x) - len(ASSISTANT) - len(ASSISTANT_END)).cast("long").alias("length")))
        return F.array_compact(F.zip_with(found, _with(F.transform(found, F.length), _starts), span))

    return _with(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))


def assistants_text(turns: Column) -> Column:
    """All text under the loss mask, from the turns as they were read back: what ``masked_text`` cuts out, without a search for each span."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, escapes undone, nothing between.  A block of ``BLOCK`` spans is cut out first and its spans from that, as
    a span is looked for from the start of what it is cut from."""

    def of_block(block: Column) -> Column:
        begin, last = block[0]["start"], F.element_at(block, -1)
        stretch = F.substring(formatted, begin.cast("int") + 1, (last["start"] + last["length"] - begin).cast("int"))
        own = lambda x: F.transform(block, lambda s: unescaped(F.substring(x, (s["start"] - begin).cast("int") + 1, s["length"].cast("int"))))
        return F.array_join(_with(stretch, own), "")

    blocks = lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK)), lambda i: F.slice(all_, i, BLOCK))
    return _with(spans, lambda all_: F.when(F.size(all_) > 0, F.array_join(F.transform(blocks(all_), of_block), "")).otherwise(""))
