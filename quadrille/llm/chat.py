"""Chat formatting by DataFrame functions only: a finite-state machine over roles and a template."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["Template", "format_conversations", "read_back"]


@dataclass(frozen=True)
class Template:
    """A declarative template.

    A turn is written as open, role, newline, text, close. ``loss`` names the roles whose texts
    are learned. ``moves`` is the machine: (state, role) to the next state, from ``start``; what
    is missing is an error, and a conversation is valid if it ends in one of ``final``.

    In roles and texts, ``\\`` is written ``\\\\`` and ``<|`` is written ``<\\|``, so that no
    control string can occur in them; in roles a newline is also preceded by ``\\``.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    def __post_init__(self) -> None:
        if not (self.open.startswith("<|") and self.close.startswith("<|")):
            raise ValueError("control strings begin with <|, which texts cannot hold once escaped")


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _name(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("\\\n"))


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text)``.

    Turns stand in order of turn, then role and text; null turns come first. Null roles and texts
    count as empty. A null conv_id is one conversation of its own. Repeated rows are repeated
    turns. Other columns are ignored; an empty table gives an empty result. Nothing is left out
    of an invalid conversation: it is formatted like any other and flagged.

    Returns ``conv_id``, ``formatted``, ``segments`` (array of text and loss flag, which
    concatenated are ``formatted``), ``loss_spans`` (array of start and length in code points of
    ``formatted``, from 0), ``valid`` and ``state`` (the machine's last; ``error at N`` names the
    first turn, from 0, that it doesn't allow).
    """
    t = template or Template()
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    written = F.char_length(_name(F.col("role"))) + F.char_length(_escape(F.col("text"))) + len(t.open) + 1 + len(t.close)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.coalesce(F.sum(written.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at")
    rows = turns.select("conv_id", "turn", role, text).select("conv_id", "turn", "role", "text", at)
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at"))).alias("turns"))
    table = F.create_map(*[F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}\n{r}", to)])

    def move(state: Column, x: Column) -> Column:
        to = F.try_element_at(table, F.concat(state["s"], F.lit("\n"), x["role"]))
        bad = F.startswith(state["s"], F.lit("error"))
        s = F.when(bad, state["s"]).otherwise(F.coalesce(to, F.concat(F.lit("error at "), state["n"].cast("string"))))
        return F.struct(s.alias("s"), (state["n"] + 1).alias("n"))

    state = F.aggregate("turns", F.struct(F.lit(t.start).alias("s"), F.lit(0).alias("n")), move)["s"]

    def segments(x: Column) -> Column:
        def segment(c: Column, loss: Column) -> Column:
            return F.struct(c.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(t.open), _name(x["role"]), F.lit("\n"))
        return F.array(segment(head, F.lit(False)), segment(_escape(x["text"]), x["role"].isin(*t.loss)), segment(F.lit(t.close), F.lit(False)))

    out = convs.select("conv_id", "turns", state.alias("state"), F.flatten(F.transform("turns", segments)).alias("segments"))
    before = lambda x: F.char_length(_name(x["role"])) + len(t.open) + 1
    spans = F.transform(F.filter("turns", lambda x: x["role"].isin(*t.loss)), lambda x: F.struct((x["at"] + before(x)).alias("start"), F.char_length(_escape(x["text"])).cast("long").alias("length")))
    return out.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        spans.alias("loss_spans"),
        F.col("state").isin(*t.final).alias("valid"),
        "state",
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse ``formatted`` and ``loss_spans`` again.

    Returns ``conv_id``, ``turns`` (array of role and text, unescaped), ``loss_text`` (the texts
    under the mask, unescaped, with nothing between) and ``formatted_chars``.
    """
    t = template or Template()
    quote = lambda s: "".join(c if c.isalnum() or c in "_\n" else f"\\{c}" for c in s)
    parts = F.split("formatted", quote(t.close))
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))  # after the last close stands nothing
    head = r"(?s)^" + quote(t.open) + r"([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"

    def turn(x: Column) -> Column:
        role = F.regexp_extract(x, head, 1)
        at = len(t.open) + F.char_length(role) + 2
        return F.struct(_unescape(role).alias("role"), _unescape(F.substr(x, at)).alias("text"))

    loss = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"), _unescape(F.array_join(loss, "")).alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))
