"""Chat formatting with a grammar round trip, with built-in functions only.

The template writes a turn as an opening marker, its text and a closing marker:

    <s>[INST] text [/INST]</s>      a user's turn
    <s>[ANSWER] text [/ANSWER]</s>  an assistant's turn
    <s>[ROLE] role [TEXT] text [/ROLE]</s>  any other role

Control strings are ``<s>``, ``</s>`` and the bracketed names. The parser is deterministic: it splits the rendered text at
``<s>`` and ``</s>``, takes the role from the opening marker and the text between the markers, and undoes the escapes.
An escape is a name between & and ; that stands for one character: ``&lt;`` ``&lb;`` ``&amp;``.

A text (or role) without control strings is first rendered as it is, parsed again, and compared with its source. With control
strings, or where the two differ, they and ampersands are escaped and it is parsed again; where they still differ, all its ``<``, ``[`` and ``&`` are
escaped. The last form holds no character that begins a marker, so it always comes back identical.

Rendering and the round trip work row by row; only the finished turns of a conversation meet, since the formatted
conversation is one value. Rows of a conversation stand by turn (nulls last), then role and text, so that ties and
repeated rows have one order; repeated rows stay. Null texts and roles count as empty; rows with null conv_id are one
conversation. The loss mask is the places of the assistants' texts in the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.steps import computed_once

#: Fixed values of the template: opening and closing marker of a turn.
USER = ("<s>[INST] ", " [/INST]</s>")
ASSISTANT = ("<s>[ANSWER] ", " [/ANSWER]</s>")
OTHER = ("<s>[ROLE] ", " [TEXT] ", " [/ROLE]</s>")
CONTROL = ("</s>", "<s>", "[/INST]", "[INST]", "[/ANSWER]", "[ANSWER]", "[/ROLE]", "[ROLE]", "[TEXT]")

LEVELS = 3


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, level: int) -> Column:
    """``text`` with its control strings (1) or all characters that begin one (2) escaped."""
    if level == 0:
        return text
    text = _replaced(text, [("&", "&amp;")])
    if level == 1:
        return _replaced(text, [(c, ("&lt;" if c[0] == "<" else "&lb;") + c[1:]) for c in CONTROL])
    return _replaced(text, [("<", "&lt;"), ("[", "&lb;")])


def unescaped(text: Column) -> Column:
    return _replaced(text, [("&lt;", "<"), ("&lb;", "["), ("&amp;", "&")])


def rendered(role: Column, text: Column) -> Column:
    return (F.when(role == "user", F.concat(F.lit(USER[0]), text, F.lit(USER[1])))
            .when(role == "assistant", F.concat(F.lit(ASSISTANT[0]), text, F.lit(ASSISTANT[1])))
            .otherwise(F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2]))))


def _inner(body: Column, opening: str, closing: str) -> Column:
    """What stands between two markers at the ends of ``body``; null if they are not there."""
    length = F.length(body) - len(opening) - len(closing)
    return F.when(body.startswith(opening) & body.endswith(closing) & (length >= 0), F.substring(body, F.lit(len(opening) + 1), length))


def parsed_turn(body: Column) -> Column:
    """The role, the raw text and where it begins in ``body``, the rendered turn without its ``<s>`` and ``</s>``; null fields
    where the grammar does not hold."""
    user, assistant = _inner(body, USER[0][3:], USER[1][:-4]), _inner(body, ASSISTANT[0][3:], ASSISTANT[1][:-4])
    other = _inner(body, OTHER[0][3:], OTHER[2][:-4])
    split = F.instr(other, OTHER[1])
    role = (F.when(user.isNotNull(), F.lit("user")).when(assistant.isNotNull(), F.lit("assistant"))
            .when(split > 0, unescaped(F.substring(other, F.lit(1), split - 1))))
    text = F.coalesce(user, assistant, F.when(split > 0, F.substring(other, split + len(OTHER[1]), F.length(other))))
    at = (F.when(user.isNotNull(), F.lit(len(USER[0]) - 3)).when(assistant.isNotNull(), F.lit(len(ASSISTANT[0]) - 3))
          .otherwise(split + len(OTHER[0]) - 3 + len(OTHER[1]) - 1))
    return F.struct(role.alias("role"), text.alias("raw"), at.alias("at"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation in order: (role, text, start, end), the places being code points of the raw text
    (end exclusive). The split at ``</s>`` leaves an empty last piece."""
    pieces = F.split(formatted, "</s>", -1)
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        F.when(p.startswith("<s>"), F.substring(p, F.lit(4), F.length(p))).alias("body"), F.length(p).alias("size")))
    turns = F.transform(bodies, lambda b: F.struct(parsed_turn(b["body"]).alias("turn"), b["size"].alias("size")))
    none = F.array().cast("array<struct<role:string,text:string,start:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + 3 + x["turn"]["at"]
        one = F.struct(x["turn"]["role"].alias("role"), x["turn"]["raw"].alias("text"), start.alias("start"), (start + F.length(x["turn"]["raw"])).alias("end"))
        return F.struct(F.array_append(state["turns"], one).alias("turns"), (state["at"] + x["size"] + 4).alias("at"))

    return F.aggregate(turns, F.struct(none.alias("turns"), F.lit(0).alias("at")), step, lambda s: s["turns"])


def _conflicting(text: Column) -> Column:
    """Whether ``text`` holds a control string."""
    return text.rlike(r"</?s>|\[/?(?:INST|ANSWER|ROLE)\]|\[TEXT\]")


def render_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered): each row rendered with the least escaping that parses back to its source."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    last = LEVELS - 1
    choice = rendered(escaped(role, last), escaped(text, last))
    same = []
    for level in range(last):
        turn, back = F.col(f"turn{level}"), F.col(f"back{level}")
        rows = computed_once(rows, f"turn{level}", rendered(escaped(role, level), escaped(text, level)))
        rows = computed_once(rows, f"back{level}", parsed_turn(F.substring(turn, F.lit(4), F.length(turn) - 7)))
        one = (F.instr(turn, "</s>") == F.length(turn) - 3) & (F.locate("<s>", turn, 2) == 0)
        if level == 0:
            one = one & ~_conflicting(role) & ~_conflicting(text)
        same.append((one & back["role"].eqNullSafe(role) & unescaped(back["raw"]).eqNullSafe(text), turn))
    for holds, turn in reversed(same):
        choice = F.when(holds, turn).otherwise(choice)
    return computed_once(rows, "rendered", choice).select("conv_id", "turn", "role", "text", "rendered")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (parsed back from it) and loss_mask (the places of the assistants'
    texts in it)."""
    turns = render_rows(conversations)
    order = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text", "rendered")
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("rows"))
    whole = whole.select("conv_id", F.array_join(F.transform("rows", lambda r: r["rendered"]), "").alias("formatted"))
    found = whole.withColumn("turns", F.explode(F.array(parsed(F.col("formatted")))))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return found.select("conv_id", "formatted", F.transform("turns", lambda t: t.withField("text", unescaped(t["text"]))).alias("turns"), mask.alias("loss_mask"))
