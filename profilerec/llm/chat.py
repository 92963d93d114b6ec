"""Chat formatting: heterogeneous records to canonical turns, one marked string and its loss mask.

The nested field paths that a record fills are hashed; the hash selects a declared mapping. All
steps are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"

#: Control characters of the template and of common chat templates, and how texts carry them.
ESCAPES = (("\\", "\\5c"), ("<", "\\3c"), ("[", "\\5b"))
ROLE_ESCAPES = (*ESCAPES, ("|", "\\7c"))
OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"

#: Roles of the from / value layout.
SPEAKERS = {"human": "user", "gpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A mapping for all records that fill ``required`` and any of ``optional`` paths, and no others.

    ``[]`` in a path stands for the elements of an array.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: Callable[[], Column]


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _messages() -> Column:
    return F.transform("messages", lambda m: _turn(m["role"], m["content"]))


def _speakers() -> Column:
    def role(m: Column) -> Column:
        out = m["from"]
        for name, canonical in SPEAKERS.items():
            out = F.when(m["from"] == name, F.lit(canonical)).otherwise(out)
        return out

    return F.transform("conversations", lambda m: _turn(role(m), m["value"]))


def _instruction(system: bool, given: bool) -> Column:
    ask = F.concat(F.col("instruction"), F.lit("\n\n"), F.col("input")) if given else F.col("instruction")
    turns = [_turn("user", ask), _turn("assistant", F.col("output"))]
    return F.array(*([_turn("system", F.col("system"))] if system else []), *turns)


def _prompt(answer: str) -> Callable[[], Column]:
    return lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col(answer)))


LAYOUTS = (
    Layout("messages", ("messages",), ("messages[].role", "messages[].content"), _messages),
    Layout("speakers", ("conversations",), ("conversations[].from", "conversations[].value"), _speakers),
    *(
        Layout("instruction", ("instruction", "output", *(["system"] if s else []), *(["input"] if g else [])), (),
               lambda s=s, g=g: _instruction(s, g))
        for s in (False, True) for g in (False, True)
    ),
    Layout("prompt_completion", ("prompt", "completion"), (), _prompt("completion")),
    Layout("prompt_response", ("prompt", "response"), (), _prompt("response")),
)


def _some_have(items: Column, name: str) -> Column:
    return F.exists(items, lambda x: x[name].isNotNull())


def _paths(schema: T.StructType, get: Callable[[str], Column], prefix: str = "") -> list[tuple[str, Column]]:
    """(path, condition that the record fills it) of every nested field."""
    found: list[tuple[str, Column]] = []
    for field in schema.fields:
        value, path = get(field.name), prefix + field.name
        found.append((path, value.isNotNull()))
        kind = field.dataType
        if isinstance(kind, T.StructType):
            found += _paths(kind, lambda n, v=value: v[n], path + ".")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for inner in kind.elementType.fields:
                found.append((f"{path}[].{inner.name}", _some_have(value, inner.name)))
    return found


def fingerprint(schema: T.StructType, columns: Sequence[str]) -> Column:
    """Hash of the sorted nested paths, among ``columns``, that a record fills.

    Fields inside arrays of structs count once for all elements; deeper arrays count as one field.
    """
    own = T.StructType([f for f in schema.fields if f.name in set(columns)])
    paths = _paths(own, lambda n: F.col(f"`{n}`"))
    if not paths:
        return F.xxhash64(F.lit(""))
    names = F.array_sort(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for p, c in paths]), lambda p: p.isNotNull()))
    return F.xxhash64(F.concat_ws("\n", names))


def _hash_of(paths: Sequence[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def canonical_turns(records: DataFrame, columns: Sequence[str], layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``schema_hash``, ``layout`` and ``turns`` (array of role and text) to ``records``.

    ``columns`` are those that may hold the record's content; other columns pass through, and ones
    named like the added columns are replaced. Null roles and texts become empty. A record whose
    filled paths fit no layout gets a null layout and null turns. A null array element is a turn
    with empty role and text.
    """
    rows = records.drop(*[c for c in ("schema_hash", "layout", "turns") if c in records.columns and c not in columns])
    types = {f.name: f.dataType for f in rows.schema.fields}

    def usable(layout: Layout) -> bool:
        return all(p.split("[]")[0].split(".")[0] in types for p in layout.required)

    key = F.col("_print")
    name = F.lit(None).cast("string")
    turns = F.lit(None).cast(TURNS)
    for layout in filter(usable, layouts):
        variants = [(*layout.required, *extra) for n in range(len(layout.optional) + 1) for extra in combinations(layout.optional, n)]
        chosen = key.isin(*[_hash_of(v) for v in variants])
        name = F.when(chosen, F.lit(layout.name)).otherwise(name)
        turns = F.when(chosen, layout.turns().cast(TURNS)).otherwise(turns)
    out = rows.withColumn("_print", fingerprint(rows.schema, columns)).withColumn("_layout", name).withColumn("_turns", turns)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("schema_hash", "layout", "turns")]
    return out.select(*kept, F.col("_print").alias("schema_hash"), F.col("_layout").alias("layout"), F.col("_turns").alias("turns"))


def escape(text: Column, table: Sequence[tuple[str, str]] = ESCAPES) -> Column:
    """``text`` without template characters: each becomes a backslash and two hex digits."""
    for raw, code in table:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, table: Sequence[tuple[str, str]] = ESCAPES) -> Column:
    """Inverse of :func:`escape`; the backslash itself is restored last."""
    for raw, code in reversed(table):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_turns(records: DataFrame, trained_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (array of start and length, in characters from 0).

    A turn is written ``<|role|>``, a line break, its escaped text and ``<|end|>`` with a line
    break. Spans cover the escaped texts of ``trained_roles``, in order, without any mark. Null
    turns give nulls; no turns give an empty string and no spans.
    """
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(MIDDLE))
    pieces = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*trained_roles).alias("trained"),
    ))
    sizes = F.transform("_pieces", lambda p: F.struct(
        F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body"), p["trained"].alias("trained"),
    ))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        span = F.array(F.struct((acc["at"] + s["head"]).alias("start"), s["body"].alias("length")))
        return F.struct(
            (acc["at"] + s["head"] + s["body"] + len(END)).alias("at"),
            F.when(s["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate(sizes, start, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    kept = [F.col(f"`{c}`") for c in records.columns if c not in ("formatted", "loss_spans")]
    return records.withColumn("_pieces", pieces).select(*kept, text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns that a formatted string holds; the inverse of :func:`format_turns`."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, MIDDLE, 1)
        body = F.substring(p, F.length(role) + len(MIDDLE) + 1, F.length(p))
        return F.struct(
            unescape(F.substring(role, F.lit(len(OPEN) + 1), F.length(role)), ROLE_ESCAPES).alias("role"), unescape(body).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text below the loss mask, concatenated."""
    piece = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, piece), "")


def records_of_rows(rows: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """(conversation, messages): one record per conversation from a table with one row per turn.

    Turns are ordered by ``order``, role and text; repeated rows stay, and rows of a null
    conversation form one of their own. One conversation is one row of the result.
    """
    turn = F.struct(F.col(order).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    sorted_turns = F.array_sort(F.collect_list(turn))
    return rows.groupBy(conversation).agg(sorted_turns.alias("t")).select(
        conversation, F.transform("t", lambda x: F.struct(x["role"], x["content"])).alias("messages")
    )
