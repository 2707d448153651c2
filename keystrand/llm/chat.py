"""Chat formatting with schema fingerprints; DataFrame functions only.

A layout is a declarative rule to canonical turns (role, text), registered under the fingerprint of its sorted nested field
paths.  Of a table's or a JSON text's paths, those of each layout are hashed, and the layout whose registered fingerprint that
is gives the rule; of several the one with the most paths.  So other fields (an id, a source, a name) don't hide a layout, and
field types don't count.  An empty list is a layout with paths of its own and no turns.  Tables are recognised by their schema
on the driver; JSON rows by their own keys, so one column may mix layouts.

Template.  A turn is ``<turn>role\\n text</turn>\\n`` (without the blank).  Inside roles and texts a backslash becomes
``\\b``, the first character of ``<turn>`` and ``</turn>`` becomes ``\\l``, that of ``### `` becomes ``\\h``, and in roles a
newline becomes ``\\n``; every backslash in the output starts such a code, so the way back is exact.

Edge cases: null roles and texts are empty; turns are ordered by (turn, role, text), null turns first; repeated rows are
repeated turns; a null conversation id is a conversation; unknown layouts give a null layout and no turns; an empty table
gives no rows; other columns are not read, and those named ``layout`` or ``turns`` are replaced; a very long text is one
value.  A long conversation is joined from blocks of ``BLOCK`` turn numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ._shared import plain

OPEN, CLOSE, HEADING = "<turn>", "</turn>", "### "
BLOCK = 256
LOSS_ROLE = "assistant"


# ---------------------------------------------------------------- layouts


def field_paths(schema: DataType, at: str = "") -> list[str]:
    """Sorted nested paths: ``a.b`` for a field of a struct, ``a[]`` for an array's elements."""
    if isinstance(schema, StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


def _list(column: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Callable], Column]:
    def rule(get: Callable) -> Column:
        def one(x: Column) -> Column:
            r = x[role]
            for old, new in (names or {}).items():
                r = F.when(x[role] == old, new).otherwise(r)
            return _turn(r, x[text])

        return F.transform(get(column), one)

    return rule


#: layout -> (paths, Spark type of the JSON, rule that gives an array of (role, text) from a field getter)
LAYOUTS: dict[str, tuple[list[str], str, Callable]] = {
    "messages": (["messages[].role", "messages[].content"], "messages array<struct<role string, content string>>", _list("messages", "role", "content")),
    "no_messages": (["messages[]"], "messages array<string>", lambda get: F.array()),
    "no_turns": (["turns[]"], "turns array<string>", lambda get: F.array()),
    "no_conversations": (["conversations[]"], "conversations array<string>", lambda get: F.array()),
    "turns": (["turns[].role", "turns[].text"], "turns array<struct<role string, text string>>", _list("turns", "role", "text")),
    "conversations": (["conversations[].from", "conversations[].value"], "conversations array<struct<`from` string, value string>>", _list("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    "prompt": (["prompt", "response"], "prompt string, response string", lambda get: F.array(_turn("user", get("prompt")), _turn("assistant", get("response")))),
    "completion": (["prompt", "completion"], "prompt string, completion string", lambda get: F.array(_turn("user", get("prompt")), _turn("assistant", get("completion")))),
    "instruction": (["instruction", "output"], "instruction string, output string", lambda get: F.array(_turn("user", get("instruction")), _turn("assistant", get("output")))),
    "instruction_input": (
        ["instruction", "input", "output"],
        "instruction string, input string, output string",
        lambda get: F.array(_turn("user", F.concat_ws("\n\n", get("instruction"), F.when(get("input") != "", get("input")))), _turn("assistant", get("output"))),
    ),
    "system_prompt": (["system", "prompt", "response"], "system string, prompt string, response string", lambda get: F.array(_turn("system", get("system")), _turn("user", get("prompt")), _turn("assistant", get("response")))),
}
#: one turn a row
ROW_LAYOUTS: dict[str, dict[str, str]] = {
    "turn_rows": {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"},
    "message_rows": {"conversation_id": "conv_id", "index": "turn", "role": "role", "content": "text"},
}


def _by_fingerprint(layouts: dict[str, list[str]]) -> list[tuple[str, list[str], str]]:
    """(fingerprint, paths, name) of layouts by their paths, those with most paths first."""
    return sorted(((fingerprint(paths), sorted(paths), name) for name, paths in layouts.items()), key=lambda x: (-len(x[1]), x[2]))


def choose(paths: list[str], layouts: dict[str, list[str]]) -> str | None:
    """The layout whose fingerprint its share of ``paths`` has."""
    return next((name for mark, known, name in _by_fingerprint(layouts) if fingerprint([p for p in set(paths) if p in known]) == mark), None)


_LISTS = sorted({p.partition("[")[0] for paths, _, _ in LAYOUTS.values() for p in paths if "[" in p})


def json_paths(json: Column) -> Column:
    """Field paths of a JSON object, elements of the known lists included; null if it is none."""
    top = F.json_object_keys(json)
    lists = F.from_json(json, ", ".join(f"{c} array<string>" for c in _LISTS))

    def inside(c: str) -> Column:
        keys = F.array_distinct(F.flatten(F.transform(F.coalesce(lists[c], F.array().cast("array<string>")), lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")))))
        return F.when(lists[c].isNull(), F.array(F.lit(c))).when(F.size(keys) == 0, F.array(F.lit(f"{c}[]"))).otherwise(F.transform(keys, lambda k: F.concat(F.lit(f"{c}[]."), k)))

    parts = [F.when(F.array_contains(top, c), inside(c)).otherwise(F.array().cast("array<string>")) for c in _LISTS]
    return F.concat(F.array_except(top, F.array(*map(F.lit, _LISTS))), *parts)


def json_layout(json: Column, layouts: dict[str, list[str]]) -> Column:
    """:func:`choose` for the paths of each JSON text."""
    paths = json_paths(json)
    out = F.lit(None).cast("string")
    for mark, known, name in reversed(_by_fingerprint(layouts)):
        mine = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, known))))
        out = F.when(F.sha2(F.array_join(mine, "\n"), 256) == mark, name).otherwise(out)
    return out


def canonical_json(df: DataFrame, column: str = "json") -> DataFrame:
    """``df`` with ``layout`` and ``turns`` (array of role and text) for a column of JSON texts in any known layout."""
    layout = json_layout(F.col(f"`{column}`"), {name: paths for name, (paths, _, _) in LAYOUTS.items()})
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("layout", "turns")]
    rows = df.select(*kept, F.col(f"`{column}`").alias("__json"), layout.alias("layout"))
    kind = "array<struct<role:string,text:string>>"
    turns = F.array().cast(kind)
    for name, (_, fields, rule) in LAYOUTS.items():
        parsed = F.from_json("__json", fields)
        turns = F.when(F.col("layout") == name, F.coalesce(rule(lambda f, p=parsed: p[f]).cast(kind), F.array().cast(kind))).otherwise(turns)
    return rows.select(*kept, "layout", turns.alias("turns"))


def canonical_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table with one turn a row; extra columns don't matter."""
    names = {c.lower(): c for c in df.columns}
    layout = choose(list(names), {name: list(fields) for name, fields in ROW_LAYOUTS.items()})
    if layout is None:
        raise ValueError(f"no row layout fits the paths {field_paths(df.schema)}")
    fields = ROW_LAYOUTS[layout]
    return plain(df, *(names[f] for f in fields)).toDF(*fields.values())


def turns_of(df: DataFrame, key: str) -> DataFrame:
    """(conv_id, turn, role, text) of a table whose rows are whole conversations in a known layout; extra columns don't matter."""
    paths = field_paths(StructType([f for f in df.schema.fields if f.name != key]))
    layout = choose(paths, {name: known for name, (known, _, _) in LAYOUTS.items()})
    if layout is None:
        raise ValueError(f"no layout fits the paths {paths}")
    turns = LAYOUTS[layout][2](lambda f: F.col(f"`{f}`")).cast("array<struct<role:string,text:string>>")
    return df.select(F.col(key).alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


# ---------------------------------------------------------------- template


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    c = _swap(F.coalesce(c, F.lit("")), "\\", "\\b")
    for control, code in ((OPEN, "\\l"), (CLOSE, "\\l"), (HEADING, "\\h")):
        c = _swap(c, control, code + control[1:])
    return c


def unescape(c: Column) -> Column:
    return _swap(_swap(_swap(c, "\\l", "<"), "\\h", "#"), "\\b", "\\")


def _format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _swap(escape(role), "\n", "\\n"), F.lit("\n"), escape(text), F.lit(f"{CLOSE}\n"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one training text a conversation, from rows (conv_id, turn, role, text)."""
    rows = canonical_rows(turns)
    block = rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    block = block.select("conv_id", "block", F.array_join(F.transform("t", lambda t: _format_turn(t["role"], t["text"])), "").alias("part"))
    whole = block.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("p"))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda p: p["part"]), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """Array of (role, text, loss) read back from a formatted text; loss: whether the text is trained on."""
    pieces = F.filter(F.split(formatted, f"{CLOSE}\n"), lambda x: x != "")

    def one(x: Column) -> Column:
        role = unescape(_swap(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1), "\\n", "\n"))
        text = unescape(F.substr(x, F.locate("\n", x) + 1))
        return F.struct(role.alias("role"), text.alias("text"), (role == LOSS_ROLE).alias("loss"))

    return F.transform(pieces, one)


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from ``formatted``."""
    read = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("t"))
    loss = F.array_join(F.transform(F.filter("t", lambda t: t["loss"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )
