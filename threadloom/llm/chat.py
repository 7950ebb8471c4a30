"""Chat formatting: schema fingerprints select declarative mappings that turn
rows of different layouts into canonical turns, which a template then renders.

A row's fingerprint is the hash of the sorted nested paths that hold a value
in it, of those paths that some layout names. Layouts are data: which paths
they need, which they may have, and an expression for their turns. Everything
is DataFrame functions; nothing leaves the JVM.

Template: ``### Role: text </turn>\\n`` for each turn. Inside roles and texts a
backslash goes before each backslash, ``#``, a ``/`` that follows ``<``, and (in
roles) ``:``, so no text can hold a control string, and one pass undoes it.

Defined results: null text or role is empty; a row that fits no layout keeps
its id, has layout ``unknown`` and no turns. Rows of one conversation are put in
order by turn, then role, then text (null turn first); repeated rows are turns
of their own, and a row that fits no layout is an empty turn there. A null conversation id is one conversation. Other columns, those
named like outputs included, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
END = " </turn>\n"
#: Other names of the canonical roles (fixed values).
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``needs``: paths that hold a value; ``may``: paths that may; ``turns``:
    makes the turns, given a function from a path to its column."""

    name: str
    needs: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column]
    may: tuple[str, ...] = field(default=())


def _turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _canonical_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(known[F.lower(role)], role)


def _listed(path: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda at: F.transform(at(path), lambda m: _turn(_canonical_role(m[role]), m[text]))


LAYOUTS = [
    Layout("turn_rows", ("turn",), lambda at: F.array(_turn(at("role"), at("text"))), ("role", "text")),
    Layout("turn_rows", ("role",), lambda at: F.array(_turn(at("role"), at("text"))), ("text",)),
    Layout("turn_rows", ("text",), lambda at: F.array(_turn(at("role"), at("text")))),
    Layout("messages", ("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    Layout("prompt_response", ("prompt", "response"), lambda at: F.array(_turn("user", at("prompt")), _turn("assistant", at("response")))),
    Layout("prompt_completion", ("prompt", "completion"), lambda at: F.array(_turn("user", at("prompt")), _turn("assistant", at("completion")))),
    Layout(
        "instruction",
        ("instruction", "output"),
        lambda at: F.array(_turn("user", F.concat_ws("\n\n", at("instruction"), F.nullif(at("input"), F.lit("")))), _turn("assistant", at("output"))),
        ("input",),
    ),
    Layout("question_answer", ("question", "answer"), lambda at: F.array(_turn("user", at("question")), _turn("assistant", at("answer")))),
]


def nested_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Leaf paths of a schema; ``[]`` steps into an array."""
    out = []
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += nested_paths(kind.elementType, f"{path}[].")
        elif isinstance(kind, T.StructType):
            out += nested_paths(kind, f"{path}.")
        else:
            out.append(path)
    return out


def _digest(paths: Column) -> Column:
    return F.md5(F.array_join(paths, "\n"))


def fingerprint(df: DataFrame, layouts: list[Layout] = LAYOUTS) -> Column:
    """The hash of the row's nested paths that hold a value. A path into an
    array holds one where the array isn't null."""
    named = {p for x in layouts for p in (*x.needs, *x.may)}
    here = sorted(named & set(nested_paths(df.schema)))
    held = [F.when(F.col(p.split("[]")[0]).isNotNull(), F.lit(p)) for p in here]
    return _digest(F.array_compact(F.array(*held))) if held else F.md5(F.lit(""))


def _prints(df: DataFrame, layout: Layout) -> list[Column]:
    """The fingerprints that select a layout: its needs with any of its mays."""
    may = [p for p in layout.may if p in set(nested_paths(df.schema))]
    some = [c for n in range(len(may) + 1) for c in combinations(may, n)]
    return [_digest(F.array(*[F.lit(p) for p in sorted({*layout.needs, *c})])) for c in some]


def canonical_turns(df: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` and ``turns`` (role, text), chosen row by row by the
    fingerprint. Columns of these names are replaced."""
    paths = set(nested_paths(df.schema))
    at = lambda p: F.col(p) if p in paths or p in df.columns else F.lit(None).cast("string")
    name = turns = None
    for x in layouts:
        if set(x.needs) <= paths:
            chosen = F.col("__print").isin(*_prints(df, x))
            made = x.turns(at).cast(TURNS)
            name = F.when(chosen, x.name) if name is None else name.when(chosen, x.name)
            turns = F.when(chosen, made) if turns is None else turns.when(chosen, made)
    if name is None:
        return df.withColumn("layout", F.lit("unknown")).withColumn("turns", F.lit(None).cast(TURNS))
    out = df.withColumn("__print", fingerprint(df, layouts))
    return out.select(*[c for c in df.columns if c not in ("layout", "turns")], F.coalesce(name, F.lit("unknown")).alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#]|(?<=<)/)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> tuple[Column, Column]:
    """A turn's text in the template, and how much of it precedes the text."""
    head = F.concat(F.lit("### "), F.regexp_replace(escape(role), ":", r"\\:"), F.lit(": "))
    return F.concat(head, escape(text), F.lit(END)), F.length(head)


def gather_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, turns): canonical turns of a conversation's rows in order."""
    turns = canonical_turns(rows)
    each = turns.select(F.col(conv_col), F.col(turn_col).alias("__turn"), F.posexplode(F.coalesce("turns", F.array(_turn("", F.lit(""))))).alias("__pos", "__t"))
    order = F.struct("__turn", "__pos", F.col("__t.role"), F.col("__t.text"))
    listed = F.sort_array(F.collect_list(order))
    return each.groupBy(conv_col).agg(F.transform(listed, lambda x: F.struct(x["role"], x["text"])).cast(TURNS).alias("turns"))


def format_turns(df: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: where in it (code points, end
    exclusive) the texts of ``loss_role`` lie."""

    def step(state: Column, turn: Column) -> Column:
        text, head = render_turn(turn["role"], turn["text"])
        end = state["at"] + F.length(text)
        span = F.when(turn["role"] == loss_role, F.array(F.struct((state["at"] + head).alias("start"), (end - len(END)).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(state["spans"], span).alias("spans"))

    turns = F.col(turns_col)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return df.withColumns({
        "formatted": F.array_join(F.transform(turns, lambda t: render_turn(t["role"], t["text"])[0]), ""),
        "loss_spans": F.aggregate(turns, zero, step, lambda s: s["spans"]),
    })


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: what ``format_turns`` was given."""
    pieces = F.filter(F.split(formatted, END), lambda x: x != "")
    of = lambda x, k: unescape(F.regexp_extract(x, r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$", k))
    return F.transform(pieces, lambda x: F.struct(of(x, 1).alias("role"), of(x, 2).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
