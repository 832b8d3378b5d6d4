"""Chat formatting of typed content parts, all in column expressions (operator 12).

A message is a list of parts: text, image, audio, document. A visitor has one
method for each kind and turns a part into a piece of the message: escaped text,
or a placeholder with the reference and the number of tokens that it stands for.
The pieces in their order, between the template's marks, are the formatted turn.

Text can hold the strings that mark turns, of this template or another. An escape
character goes in after the first character of each, and one of its own is
doubled. So no mark occurs in a formatted turn but those of the template, a
tokenizer that knows the marks finds no other, and ``unescaped`` gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A content part. ``ref`` names an attachment; the numbers are its size, NULL where unknown.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
# Marks of common chat templates, which texts may hold.
FOREIGN = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<start_of_turn>", "<end_of_turn>",
)


@dataclass(frozen=True)
class Template:
    """Marks around a turn, placeholders of attachments, their sizes in tokens, roles under the loss mask."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    attachment: str = "<|attachment|>"
    escape: str = "␛"
    foreign: tuple[str, ...] = FOREIGN
    loss_roles: tuple[str, ...] = ("assistant",)
    image_patch: int = 28
    image_tokens: int = 256
    audio_tokens_per_second: float = 12.5
    page_tokens: int = 1024

    def __post_init__(self):
        for mark in self.controls:
            if len(mark) < 2 or self.escape in mark:
                raise ValueError(f"a mark has two characters at least and no escape character: {mark!r}")
        for mark in self.controls:
            for other in self.controls:
                if mark != other and other.startswith(mark):
                    raise ValueError(f"{mark!r} begins {other!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        own = (self.turn, self.says, self.end, self.image, self.audio, self.document, self.attachment)
        return tuple(dict.fromkeys((*own, *self.foreign)))


DEFAULT = Template()


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    """``text`` without any of the template's control strings; see ``unescaped``."""
    rests: dict[str, list[str]] = {}
    for mark in template.controls:
        rests.setdefault(mark[0], []).append(re.escape(mark[1:]))
    pattern = "|".join(f"{re.escape(first)}(?={'|'.join(rest)})" for first, rest in rests.items())
    doubled = F.replace(text, F.lit(template.escape), F.lit(template.escape * 2))
    return F.regexp_replace(doubled, pattern, "$0" + template.escape)


def guarded(piece: Column, template: Template = DEFAULT) -> Column:
    """Escaped text that other text follows: an end that could begin a control string is broken as well."""
    begun: dict[str, set[str]] = {}
    for mark in template.controls:
        begun.setdefault(mark[0], set()).update(re.escape(mark[1:n]) for n in range(1, len(mark)))
    pattern = "|".join(rf"{re.escape(first)}(?=(?:{'|'.join(sorted(rest))})\z)" for first, rest in begun.items())
    return F.regexp_replace(piece, pattern, "$0" + template.escape)


def unescaped(text: Column, template: Template = DEFAULT) -> Column:
    """The text that ``escaped`` was given: of each pair of escape characters one stays, a single one goes."""
    return F.regexp_replace(text, f"{template.escape}({template.escape}?)", "$1")


class Visitor:
    """One method for each kind of part; each gives ``piece, kind, ref, tokens``.

    A subclass may add kinds: its methods ``visit_<kind>`` are found by name.
    """

    def __init__(self, template: Template = DEFAULT):
        self.template = template

    def _seen(self, part: Column, piece: Column, kind: Column | None, tokens: Column | None) -> Column:
        none = F.lit(None)
        return F.struct(
            piece.alias("piece"), (none.cast("string") if kind is None else kind).alias("kind"),
            (none.cast("string") if kind is None else part["ref"]).alias("ref"), (F.lit(0) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("bigint").alias("tokens"),
        )

    def visit_text(self, part: Column) -> Column:
        return self._seen(part, escaped(F.coalesce(part["text"], F.lit("")), self.template), None, None)

    def visit_image(self, part: Column) -> Column:
        side = lambda n: F.ceil(part[n] / self.template.image_patch)
        known = (part["width"] > 0) & (part["height"] > 0)
        tokens = F.when(known, side("width") * side("height")).otherwise(self.template.image_tokens)
        return self._seen(part, F.lit(self.template.image), F.lit("image"), tokens)

    def visit_audio(self, part: Column) -> Column:
        tokens = F.when(part["seconds"] > 0, F.ceil(part["seconds"] * self.template.audio_tokens_per_second))
        return self._seen(part, F.lit(self.template.audio), F.lit("audio"), tokens)

    def visit_document(self, part: Column) -> Column:
        return self._seen(part, F.lit(self.template.document), F.lit("document"), F.greatest(part["pages"], F.lit(1)) * self.template.page_tokens)

    def visit_other(self, part: Column) -> Column:
        return self._seen(part, F.lit(self.template.attachment), F.coalesce(part["type"], F.lit("unknown")), None)

    def visit(self, part: Column) -> Column:
        kinds = [n.removeprefix("visit_") for n in dir(self) if n.startswith("visit_") and n != "visit_other"]
        chosen = None
        for kind in sorted(kinds):
            seen = getattr(self, "visit_" + kind)(part)
            chosen = F.when(part["type"] == kind, seen) if chosen is None else chosen.when(part["type"] == kind, seen)
        return chosen.otherwise(self.visit_other(part))


def text_parts(text: Column) -> Column:
    """The parts of a message that is one text."""
    field = lambda name, kind: F.lit(None).cast(kind).alias(name)
    part = F.struct(
        F.lit("text").alias("type"), text.alias("text"), field("ref", "string"), field("width", "int"), field("height", "int"), field("seconds", "double"), field("pages", "int"),
    )
    return F.array(part)


def format_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | str = "parts",
    template: Template = DEFAULT, visitor: Visitor | None = None,
) -> DataFrame:
    """One row per turn: ``conv, turn, role, formatted, loss, attachments, n_tokens``, nothing shuffled.

    ``parts`` is an array of ``PART``. ``loss`` lists the stretches of ``formatted``
    (``start, length`` in code points from 0) that hold a loss role's own text.
    ``attachments`` lists ``place`` (the placeholder's number in the turn, from 0),
    ``kind, ref, tokens``; ``n_tokens`` sums what the placeholders expand to.

    NULL parts are left out, a NULL list is an empty message, a NULL text is empty, a NULL
    role is '' and bears no loss. A part of an unknown type is an attachment of no tokens.
    Rows that repeat stay. Only the named columns are read; an empty table gives no rows.
    """
    visitor = visitor or Visitor(template)
    given = F.col(parts) if isinstance(parts, str) else parts
    seen = F.transform(F.filter(F.coalesce(given, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), visitor.visit)
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), seen.alias("seen"))
    head = F.concat(F.lit(template.turn), escaped(F.col("role"), template), F.lit(template.says))
    base = base.select("conv", "turn", "role", head.alias("head"), "seen")
    # Two texts in a row must not make a control string together.
    followed = lambda x, i: x["kind"].isNull() & (i + 1 < F.size("seen")) & F.get("seen", i + 1)["kind"].isNull()
    base = base.withColumn("seen", F.transform("seen", lambda x, i: F.when(followed(x, i), x.withField("piece", guarded(x["piece"], template))).otherwise(x)))
    size = lambda x: F.char_length(x["piece"])
    before = lambda i: F.aggregate(F.slice("seen", F.lit(1), i), F.char_length("head"), lambda s, x: s + size(x))
    spans = F.transform("seen", lambda x, i: F.struct(before(i).alias("start"), size(x).alias("length"), x["kind"].isNull().alias("own")))
    own = F.transform(F.filter(spans, lambda s: s["own"] & (s["length"] > 0)), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    attached = F.filter("seen", lambda x: x["kind"].isNotNull())
    return base.select(
        "conv", "turn", "role",
        F.concat("head", F.array_join(F.transform("seen", lambda x: x["piece"]), ""), F.lit(template.end)).alias("formatted"),
        F.when(F.col("role").isin(*template.loss_roles), own).otherwise(F.array().cast("array<struct<start:int,length:int>>")).alias("loss"),
        F.transform(attached, lambda x, i: F.struct(i.alias("place"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("seen", F.lit(0).cast("bigint"), lambda s, x: s + x["tokens"]).alias("n_tokens"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv, n_turns, turns, n_tokens`` of what ``format_turns`` gives; a conversation's text is its turns' ``formatted`` in a row.

    ``turns`` holds ``formatted, loss, attachments`` by turn (NULL first; ties by role
    and text), so offsets stay small however long a conversation is. A task gathers what it
    has of a conversation before the shuffle. Rows without a conversation are one of their own.
    """
    row = F.struct("turn", "role", "formatted", "loss", "attachments")
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda t: F.struct(t["formatted"].alias("formatted"), t["loss"].alias("loss"), t["attachments"].alias("attachments")))
    return turns.groupBy("conv").agg(F.count("*").alias("n_turns"), listed.alias("turns"), F.sum("n_tokens").alias("n_tokens"))


def conversation_text(turns: Column) -> Column:
    """The whole formatted text."""
    return F.array_join(F.transform(turns, lambda t: t["formatted"]), "")


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """``role, text`` of each turn of a formatted text, unescaped; placeholders stay."""
    def read(turn: Column) -> Column:
        sides = F.split(turn, re.escape(template.says), 2)
        said = F.get(sides, F.lit(1))
        text = F.substring(said, F.lit(1), F.char_length(said) - len(template.end))
        return F.struct(unescaped(F.get(sides, F.lit(0)), template).alias("role"), unescaped(text, template).alias("text"))

    parts = F.split(formatted, re.escape(template.turn))
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), read)


def read_loss(turns: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    under = lambda t: F.array_join(F.transform(t["loss"], lambda s: F.substring(t["formatted"], s["start"] + 1, s["length"])), "")
    return F.array_join(F.transform(turns, lambda t: unescaped(under(t), template)), "")


def digests(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation the number of turns, code points and digests, read back from the formatted text and its mask."""
    whole = conversations.select("conv", conversation_text(F.col("turns")).alias("formatted"), read_loss(F.col("turns"), template).alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    back = whole.select("conv", "formatted", "loss", read_turns(F.col("formatted"), template).alias("back"))
    return back.select(
        "conv", F.size("back").cast("bigint").alias("n_turns"), F.sha2(F.array_join(F.transform("back", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
