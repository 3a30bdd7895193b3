"""Chat formatting with built-in functions: one formatted text per conversation, and which parts carry loss.

A template names the roles, the turn order as transitions of a finite-state machine, the marker strings, and the
roles whose text is trained on. Nothing runs in Python on the executors.

Defined cases: a null text or role is the empty string; turns are ordered by (turn, role, text), nulls first, and
repeated rows stay; rows with a null conv_id form one conversation; other columns are ignored; an empty table gives
an empty result. A conversation whose order breaks the template is formatted like any other and marked
``valid = false`` with the first bad turn's position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: What every marker begins with; texts are escaped so that it never occurs in them.
    lead: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "begin"
    #: (state, role) -> state; anything else is an error.
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("begin", "system"): "system", ("begin", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    accepting: tuple[str, ...] = ("user", "assistant")


CHAT = ChatTemplate()
#: The state after a turn that the template does not allow there, and turns or segments that are folded together.
ERROR, PART = "error", 256


def escape(text: Column, template: ChatTemplate = CHAT, newline: bool = False) -> Column:
    """Backslash becomes ``\\s`` and the marker lead gets a ``\\p`` after its first character; with ``newline`` a line
    end becomes ``\\n``. Every backslash of the result starts one of these pairs, so ``unescape`` is exact."""
    first, rest = template.lead[0], template.lead[1:]
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    out = F.replace(out, F.lit(template.lead), F.lit(f"{first}\\p{rest}"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if newline else out


def unescape(text: Column, newline: bool = False) -> Column:
    out = F.replace(text, F.lit("\\p"), F.lit(""))
    out = F.replace(out, F.lit("\\n"), F.lit("\n")) if newline else out
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def _append(acc: Column, name: str, value: Column) -> Column:
    return F.concat(acc[name], F.array(value)).alias(name)


def _cut(values: Column) -> Column:
    """An array in parts of ``PART`` elements, so that what is appended to one by one stays short."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / PART).cast("int") - 1, F.lit(0))),
                       lambda i: F.slice(values, i * PART + 1, PART))


def _step(template: ChatTemplate, moves: Column, state: Column, role: Column) -> Column:
    """The state a turn leads to; ``ERROR`` has no way out."""
    return F.coalesce(moves[F.concat(state, F.lit("\x00"), role)], F.lit(ERROR))


def run_machine(roles: Column, template: ChatTemplate) -> Column:
    """What the machine emits for each turn: the state after it and whether its text carries loss.

    A part of a long conversation is a map from entry to exit state: the maps are made first, then each part's entry
    state follows from them, then the parts emit from there.
    """
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\x00{role}", to)])
    states = sorted({template.initial, ERROR, *template.transitions.values(), *(state for state, _ in template.transitions)})
    step = lambda state, role: _step(template, moves, state, role)
    exits = lambda part: F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*[F.aggregate(part, F.lit(s), step) for s in states]))
    none = F.array().cast("array<string>").alias("seen")
    start = F.struct(F.lit(template.initial).alias("state"), none)
    entries = F.aggregate(F.transform(_cut(roles), exits), start, lambda acc, way: F.struct(way[acc["state"]].alias("state"), _append(acc, "seen", acc["state"])),
                          lambda acc: acc["seen"])

    def emit(part: Column, entry: Column) -> Column:
        out = F.array().cast("array<struct<state:string,loss:boolean>>").alias("out")

        def turn(acc: Column, role: Column) -> Column:
            to = step(acc["state"], role)
            return F.struct(to.alias("state"), _append(acc, "out", F.struct(to.alias("state"), role.isin(*template.loss_roles).alias("loss"))))

        return F.aggregate(part, F.struct(entry.alias("state"), out), turn, lambda acc: acc["out"])

    return F.flatten(F.zip_with(_cut(roles), entries, emit))


def _starts(lengths: Column) -> Column:
    """For each length, the sum of those before it: running sums within parts, and over the parts' sums."""
    none = F.array().cast("array<int>").alias("out")

    def running(values: Column, base: Column) -> Column:
        return F.aggregate(values, F.struct(base.alias("at"), none), lambda acc, n: F.struct((acc["at"] + n).alias("at"), _append(acc, "out", acc["at"])),
                           lambda acc: acc["out"])

    total = lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n)
    bases = running(F.transform(_cut(lengths), total), F.lit(0))
    return F.flatten(F.zip_with(_cut(lengths), bases, running))


def format_conversations(rows: DataFrame, template: ChatTemplate = CHAT) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (start, length, loss: code points of ``formatted``, the
    loss flag of each), valid, first_bad_turn. Segments cover the formatted text without gaps: what stands before a
    turn's text, and the text. Flags and validity are what the machine emits; a turn that breaks the order keeps its
    role's flag."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col("turn"), F.lit(-(1 << 62))).alias("turn"), text("role").alias("role"), text("text").alias("text")))).alias("turns"))
    head = lambda t: F.concat(F.lit(template.start), escape(t["role"], template, newline=True), F.lit("\n"))
    pieces = turns.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"], template).alias("body"))).alias("pieces"))
    emitted = pieces.select("conv_id", "pieces", run_machine(F.col("roles"), template).alias("emitted"))
    tail = f"{template.end}\n"
    laid = emitted.select(
        "conv_id", "emitted", F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), tail), F.lit(tail)).alias("formatted"),
        F.concat(F.flatten(F.transform("pieces", lambda p, i: F.array(F.length(p["head"]) + F.when(i > 0, len(tail)).otherwise(0), F.length(p["body"])))),
                 F.array(F.lit(len(tail)))).alias("lengths"),
        F.concat(F.flatten(F.transform("emitted", lambda e: F.array(F.lit(False), e["loss"]))), F.array(F.lit(False))).alias("flags"))
    placed = laid.withColumn("starts", _starts(F.col("lengths")))
    spans = F.transform(F.arrays_zip("starts", "lengths", "flags"), lambda s: F.struct(
        s["starts"].alias("start"), s["lengths"].alias("length"), s["flags"].alias("loss")))
    bad = F.array_position(F.transform("emitted", lambda e: e["state"]), ERROR).cast("int")
    last = F.element_at("emitted", -1)["state"]
    return placed.select("conv_id", "formatted", spans.alias("segments"), ((bad == 0) & last.isin(*template.accepting)).alias("valid"),
                         F.when(bad > 0, bad - 1).alias("first_bad_turn"))


def read_turns(formatted: Column, template: ChatTemplate = CHAT) -> Column:
    """The turns (role, text) that a formatted text holds."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in template.start)
    blocks = F.slice(F.split(formatted, quoted), 2, 1 << 30)
    return F.transform(blocks, lambda b: F.struct(
        unescape(F.substring_index(b, "\n", 1), newline=True).alias("role"),
        unescape(F.substring_index(b.substr(F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b)), template.end, 1)).alias("text")))


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order and without anything between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")
