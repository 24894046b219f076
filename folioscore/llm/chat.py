"""Chat formatting by schema fingerprints (DataFrame functions only).

A record is a variant, or a JSON text, in one of several layouts. Its fingerprint is a hash of those of its
nested field paths that any layout knows (types and other fields left out, paths in order of name); the
fingerprint selects a declarative mapping, which turns the record into canonical turns
``array<struct<role,text>>``. A template then marks turns and escapes control strings inside roles and texts so that both can be read
back exactly:

    <|turn|>ROLE<|text|>TEXT<|end|>

``\\`` is doubled and every control string gets a ``\\`` after its first character;
``unescape`` drops the first of each such pair.

The result is kept in segments ``(text, loss)``; joined they are the formatted text, and the
segments with ``loss`` (the texts of the ``assistant``) are the loss mask. All steps are linear
in the record. One record is one row of the result, so a record must fit a task.

Defined results: a null or broken record, and one whose fingerprint no mapping has, get the
layout ``unknown`` and no turns. Fields that no layout knows change nothing. A JSON text with a string that is
too long for Spark's JSON reader stops the job; a variant has no such limit on a string, and one that is
too large for its type stops the job as well. Missing roles and texts are empty. Extra columns pass
unchanged, except that the columns made here replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscore.llm.names import unused

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Where a ``\`` goes: after ``<`` or ``[`` of strings that this or other templates give meaning.
CONTROL = r"(<(?=/?s>|\||/?SYS>)|\[(?=/?INST\]))"
LOSS_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"
#: Characters of a string that Spark's JSON reader does not go beyond.
JSON_STRING = 20_000_000


@dataclass(frozen=True)
class Layout:
    """A layout: where the turns of its records are.

    ``items``: path, role field and text field of a list of turns; ``fields``: ``(role, path)``
    of single texts, empty ones but ``keep`` left out; ``roles`` renames roles.
    """

    name: str
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    keep: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages", "role", "content")),
    Layout(
        "from_value",
        ("conversations", "from", "value"),
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Layout(
        "prompt_response",
        fields=(("user", "prompt"), ("assistant", "response")),
        keep=("prompt", "response"),
    ),
    Layout(
        "system_prompt_response",
        fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
        keep=("system", "prompt", "response"),
    ),
    Layout(
        "prompt_completion",
        fields=(("user", "prompt"), ("assistant", "completion")),
        keep=("prompt", "completion"),
    ),
    Layout(
        "instruction",
        fields=(("user", "instruction"), ("assistant", "output")),
        keep=("instruction", "output"),
    ),
    Layout(
        "instruction_input",
        fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
        keep=("instruction", "output"),
    ),
)


def paths_of(layout: Layout) -> list[str]:
    """The field paths that a layout's records have."""
    if layout.items:
        path, *fields = layout.items
        return sorted([path, *(f"{path}[].{f}" for f in fields)])
    return sorted(path for _, path in layout.fields)


def _has(record: Column, path: str) -> Column:
    """Whether a variant has a path; ``a[].b`` is in it if any element of ``a`` has ``b``."""
    outer, _, inner = path.partition("[].")
    if not inner:
        return F.try_variant_get(record, f"$.{outer}", "variant").isNotNull()
    elements = F.try_variant_get(record, f"$.{outer}", "array<variant>")
    found = F.exists(elements, lambda e: F.try_variant_get(e, f"$.{inner}", "variant").isNotNull())
    return F.coalesce(found, F.lit(False))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the nested field paths of a variant that any of the layouts knows."""
    known = sorted({p for layout in layouts for p in paths_of(layout)})
    there = F.filter(F.array(*[F.when(_has(record, p), p) for p in known]), lambda p: p.isNotNull())
    return F.xxhash64(F.array_join(there, ","))


def _turns(record: Column, layout: Layout) -> Column:
    if layout.items:
        path, role, text = layout.items
        kind = f"array<struct<`{role}`:string,`{text}`:string>>"
        found = F.transform(
            F.try_variant_get(record, f"$.{path}", kind),
            lambda t: F.struct(
                F.coalesce(_renamed(t[role], layout), F.lit("")).alias("role"),
                F.coalesce(t[text], F.lit("")).alias("text"),
            ),
        )
    else:
        parts = [
            (path, F.struct(
                F.lit(role).alias("role"),
                F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit("")).alias("text"),
            ))
            for role, path in layout.fields
        ]
        kept = [F.struct(p.alias("turn"), F.lit(path in layout.keep).alias("keep")) for path, p in parts]
        found = F.transform(
            F.filter(F.array(*kept), lambda t: t["keep"] | (t["turn"]["text"] != "")),
            lambda t: t["turn"],
        )
    return found.cast(TURNS)


def _renamed(role: Column, layout: Layout) -> Column:
    return reduce(lambda out, r: F.when(role == r[0], r[1]).otherwise(out), layout.roles, role)


def _variant(df: DataFrame, record: str) -> Column:
    """The record as a variant; a JSON text that only its length keeps from being read stops the job."""
    column = F.col(record)
    if df.schema[record].dataType.typeName() == "variant":
        return column
    read = F.try_parse_json(column)
    too_long = read.isNull() & (F.length(column) >= JSON_STRING)
    stopped = F.raise_error(F.lit("a record is too long for the JSON reader: give it as a variant")).cast("variant")
    return F.when(too_long, stopped).otherwise(read)


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``layout`` and ``turns`` of the column ``record``, a variant or JSON text."""
    as_variant, print_name = unused(df, "record"), unused(df, "print")
    value, print_ = F.col(as_variant), F.col(print_name)
    name, turns = F.lit("unknown"), F.array().cast(TURNS)
    for layout in layouts:
        same = print_ == F.xxhash64(F.lit(",".join(paths_of(layout))))
        name = F.when(same, layout.name).otherwise(name)
        turns = F.when(same, _turns(value, layout)).otherwise(turns)
    return (
        df.withColumn(as_variant, _variant(df, record))
        .withColumn(print_name, fingerprint(value, layouts))
        .withColumns({"layout": name, "turns": F.coalesce(turns, F.array().cast(TURNS))})
        .drop(as_variant, print_name)
    )


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``segments`` (array of text, loss) and their joined text ``formatted``."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        head = F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
        return F.array(
            piece(head, F.lit(False)),
            piece(escape(t["text"]), t["role"] == LOSS_ROLE),
            piece(F.lit(END), F.lit(False)),
        )

    segments = F.flatten(F.transform(F.col(turns), of_turn))
    joined = F.array_join(F.transform(F.col("segments"), lambda s: s["text"]), "")
    return df.withColumn("segments", segments).withColumn("formatted", joined)


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted text."""
    parts = F.split(formatted, r"<\|turn\|>")
    parts = F.slice(parts, 2, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        fields = F.split(part, r"<\|text\|>", 2)
        text = fields[1]
        return F.struct(
            unescape(fields[0]).alias("role"),
            unescape(F.left(text, F.length(text) - len(END))).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )


def records_of(conversations: DataFrame) -> DataFrame:
    """Conversation rows ``conv_id, turn, role, text`` as one record, a variant, per conversation.

    A prompt with its response, with or without a system text before it, is stored in the
    layout of that name, all others as messages. Turns come in order of turn, role and text.
    """
    rows = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("content"),
        ).alias("_t"),
    )
    turns, roles = F.col("_turns"), F.transform(F.col("_turns"), lambda t: t["role"])
    text = [F.get(turns, F.lit(i))["content"] for i in range(3)]

    def shape(*names: str) -> Column:
        return roles == F.array(*[F.lit(n) for n in names])

    record = (
        F.when(
            shape("user", "assistant"),
            F.to_variant_object(F.struct(text[0].alias("prompt"), text[1].alias("response"))),
        )
        .when(
            shape("system", "user", "assistant"),
            F.to_variant_object(
                F.struct(text[0].alias("system"), text[1].alias("prompt"), text[2].alias("response"))
            ),
        )
        .otherwise(
            F.to_variant_object(
                F.struct(
                    F.transform(turns, lambda t: F.struct(t["role"], t["content"])).alias("messages")
                )
            )
        )
    )
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
        .select("conv_id", record.alias("record"))
    )
