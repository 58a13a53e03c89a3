"""Chat formatting: roles checked by a state machine, text laid out by a declarative template."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

START = "start"

# Which role may come next, by state, and the state it leads to.
FLOW: Mapping[str, Mapping[str, str]] = {
    START: {"system": "briefed", "user": "asked"},
    "briefed": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}


@dataclass(frozen=True)
class Template:
    """How a turn is written and what is learned from it.

    Every control string begins with ``mark`` (a character and what follows it); escaping keeps
    the mark out of texts, so control strings are found wherever they stand.
    """

    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    mark: tuple[str, str] = ("<", "|")
    trained: tuple[str, ...] = ("assistant",)
    flow: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: FLOW)
    ends: tuple[str, ...] = ("answered",)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def escape(text: Column, template: Template) -> Column:
    """Put a backslash into every mark; marks that hold some already get one more."""
    head, tail = map(_quoted, template.mark)
    return F.regexp_replace(text, rf"{head}(\\*){tail}", rf"{head}\\$1{tail}")


def unescape(text: Column, template: Template) -> Column:
    head, tail = map(_quoted, template.mark)
    return F.regexp_replace(text, rf"{head}\\(\\*){tail}", rf"{head}$1{tail}")


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _walk(roles: Column, template: Template) -> Column:
    """State behind each conversation's last turn (empty once a role was out of turn), and that turn."""
    steps = [F.lit(x) for s, n in template.flow.items() for r, t in n.items() for x in (f"{s} {r}", t)]
    moves = F.create_map(*steps)
    begin = F.struct(F.lit(START).alias("state"), F.lit(0).alias("turns"))

    def step(so_far: Column, role: Column) -> Column:
        after = F.coalesce(F.try_element_at(moves, F.concat_ws(" ", so_far.state, role)), F.lit(""))
        moved = F.struct(after.alias("state"), (so_far.turns + F.when(after == "", 0).otherwise(1)).alias("turns"))
        return F.when(so_far.state == "", so_far).otherwise(moved)

    return F.aggregate(roles, begin, step)


def format_chats(
    rows: DataFrame, template: Template = Template(), *, key: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row for each conversation: ``conv_id, segments, formatted, valid, wrong_turn``.

    ``segments`` is an array of ``(text, loss)`` in order and ``formatted`` their texts end to end.
    Turns stand in the order of ``turn``; equal ones by role, then text, a null one first.  A null
    role or text is empty.  Roles are written URL-encoded, which leaves plain names as they are.
    A conversation whose roles are out of order is formatted all the same; ``valid`` says whether
    the state machine accepted it and ``wrong_turn`` the position (from 0) of the first turn it
    refused, null where there is none.  Rows with a null key are one conversation; no rows give
    no conversation.
    """
    turns = F.array_sort(
        F.collect_list(
            F.struct(
                F.col(turn).cast("long").alias("turn"),
                F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
            )
        )
    )
    told = rows.groupBy(F.col(key).alias("conv_id")).agg(turns.alias("turns"))

    def laid_out(t: Column) -> Column:
        def segment(content: Column, loss: Column) -> Column:
            return F.struct(content.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.turn_start), F.url_encode(t.role), F.lit(template.role_end))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(t.text, template), t.role.isin(*template.trained)),
            segment(F.lit(template.turn_end), F.lit(False)),
        )

    walked = told.withColumns({
        "segments": F.flatten(F.transform("turns", laid_out)),
        "walk": _walk(F.transform("turns", lambda t: t.role), template),
    })
    refused = F.col("walk.state") == ""
    return walked.select(
        "conv_id",
        "segments",
        _joined(F.transform("segments", lambda s: s.text)).alias("formatted"),
        F.col("walk.state").isin(*template.ends).alias("valid"),
        F.when(refused, F.col("walk.turns")).alias("wrong_turn"),
    )


def turns_of(formatted: Column, template: Template = Template()) -> Column:
    """Read a formatted conversation back: an array of ``(role, text)``."""
    pieces = F.split(formatted, _quoted(template.turn_start))
    end = len(template.role_end)

    def read(piece: Column) -> Column:
        at = F.instr(piece, template.role_end)
        body = F.substring(piece, at + end, F.length(piece) - at - end + 1 - len(template.turn_end))
        return F.struct(
            F.url_decode(F.substring(piece, F.lit(1), at - 1)).alias("role"),
            unescape(body, template).alias("text"),
        )

    # Nothing stands in front of the first turn.
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), read)


def trained_text(segments: Column, template: Template = Template()) -> Column:
    """The text under the loss mask, as it was before escaping."""
    kept = F.filter(segments, lambda s: s.loss)
    return _joined(F.transform(kept, lambda s: unescape(s.text, template)))
