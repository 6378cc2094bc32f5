"""Chat formatting: any known layout to canonical turns, then to one string.

A layout is known by the SHA-256 of its sorted nested field paths. The
fingerprint selects a declarative mapping that yields canonical turns
``(conv_id, turn, role, text)``. A frame has one layout, told by its schema; a
column of JSON texts may mix layouts, told for each row.

The template writes each turn as ``<turn ROLE>TEXT</turn>`` and a newline.
Inside roles and texts, ``\\`` becomes ``\\s`` and the ``<`` of ``<turn`` and
``</turn`` becomes ``\\l`` (in roles also ``>`` becomes ``\\g``), so no text
can forge a mark and the escaping is undone exactly. The loss mask lists code
point spans of the formatted string, one for each assistant text.

Defined cases: null text or role is empty; a null conversation id is a
conversation of its own; turns sort by number, then role and text, so repeated
turn numbers are kept in a fixed order; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>\n"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``rows``: one row per turn. ``array``: a list of messages. ``fields``: one
    turn per field group ``(role, fields)``; a group's empty fields are left out."""

    name: str
    kind: str
    key: str = "id"
    items: str = ""
    order: str = ""
    role: str = ""
    text: str = ""
    groups: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    def paths(self) -> list[str]:
        if self.kind == "rows":
            return [self.key, self.order, self.role, self.text]
        if self.kind == "array":
            return [self.key, f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"]
        return [self.key, *(f for _, fields in self.groups for f in fields)]

    def fingerprint(self) -> str:
        return fingerprint(self.paths())


LAYOUTS = (
    Layout("turn rows", "rows", "conv_id", order="turn", role="role", text="text"),
    Layout("messages", "array", "id", "messages", role="role", text="content"),
    Layout("from and value", "array", "id", "conversations", role="from", text="value"),
    Layout("prompt and response", "fields", groups=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", "fields", groups=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction, input and output", "fields", groups=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question and answer", "fields", groups=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves; list items are marked ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def layout_of(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout whose fingerprint the schema has; failing that, of the largest
    layout that the schema holds besides other fields."""
    paths = schema_paths(schema)
    known = {x.fingerprint(): x for x in layouts}
    if (exact := known.get(fingerprint(paths))) is not None:
        return exact
    for x in sorted(layouts, key=lambda x: -len(x.paths())):
        if fingerprint([p for p in dict.fromkeys(paths) if p in x.paths()]) == x.fingerprint():
            return x
    raise ValueError(f"no layout has the fields {sorted(paths)}")


def _role(column: Column) -> Column:
    text = F.coalesce(column.cast("string"), F.lit(""))
    low = F.lower(text)
    out = F.when(low == "human", F.lit("user"))
    for name, role in list(ROLES.items())[1:]:
        out = out.when(low == name, F.lit(role))
    return out.otherwise(text)


def _turns(layout: Layout, get) -> Column:
    """Array of ``(role, text)``; ``get(path)`` gives a column of the record."""
    if layout.kind == "array":
        return F.transform(get(layout.items), lambda m: F.struct(_role(m[layout.role]).alias("role"), m[layout.text].cast("string").alias("text")))
    return F.array(
        *(
            F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*(get(f).cast("string") for f in fields)), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n").alias("text"))
            for role, fields in layout.groups
        )
    )


def canonical(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """``conv_id, turn, role, text`` of a frame whose schema is a known layout."""
    layout = layout_of(df.schema, layouts)
    if layout.kind == "rows":
        return df.select(F.col(layout.key).alias("conv_id"), F.col(layout.order).alias("turn"), F.col(layout.role).alias("role"), F.col(layout.text).alias("text"))
    rows = df.select(F.col(layout.key).alias("conv_id"), F.posexplode(_turns(layout, F.col)).alias("turn", "t"))
    return rows.select("conv_id", "turn", "t.role", "t.text")


def _signature(layout: Layout) -> str:
    """What ``row_fingerprint`` hashes for a JSON object of the layout."""
    if layout.kind == "array":
        inside = ", ".join(sorted((layout.role, layout.text)))
        keys = {layout.key: layout.key, layout.items: f"{layout.items}: ARRAY<OBJECT<{inside}>>"}
    else:
        keys = {p: p for p in layout.paths()}
    return f"OBJECT<{', '.join(keys[k] for k in sorted(keys))}>"


def row_fingerprint(variant: Column) -> Column:
    """SHA-256 of a JSON object's nested field names, without the leaf types."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(variant), r": [A-Z_ ]+(\([0-9, ]+\))?(?=[,>])", ""), 256)


def canonical_json(df: DataFrame, json_col: str, layouts=LAYOUTS) -> DataFrame:
    """``conv_id, layout, turn, role, text`` of a column that mixes JSON layouts.

    A row of no known layout (or no JSON) comes back once, with null layout,
    turn and role and its JSON as the text, so nothing is lost.
    """
    known = [x for x in layouts if x.kind != "rows"]
    rows = df.select(F.col(json_col).alias("j"), F.try_parse_json(json_col).alias("v")).withColumn("f", row_fingerprint(F.col("v")))
    layout = conv = turns = None
    for x in known:
        hit = F.col("f") == hashlib.sha256(_signature(x).encode()).hexdigest()

        def get(path, x=x):
            if x.kind == "array" and path == x.items:
                return F.try_variant_get("v", f"$.{path}", f"array<struct<{x.role}: string, {x.text}: string>>")
            return F.try_variant_get("v", f"$.{path}", "string")

        layout = F.when(hit, x.name) if layout is None else layout.when(hit, x.name)
        conv = F.when(hit, get(x.key)) if conv is None else conv.when(hit, get(x.key))
        turns = F.when(hit, _turns(x, get)) if turns is None else turns.when(hit, _turns(x, get))
    lost = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.col("j").alias("text")))
    out = rows.select(conv.alias("conv_id"), layout.alias("layout"), F.posexplode(F.coalesce(turns, lost)).alias("turn", "t"))
    return out.select("conv_id", "layout", F.when(F.col("layout").isNotNull(), F.col("turn")).alias("turn"), "t.role", "t.text")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s"))
    out = F.replace(F.replace(out, F.lit("</turn"), F.lit("\\l/turn")), F.lit("<turn"), F.lit("\\lturn"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` (array of ``start, length`` in code points)
    from canonical turns; one shuffle by conversation."""
    head = F.concat(F.lit("<turn "), escape(F.col("role"), role=True), F.lit(">"))
    body = escape(F.col("text"))
    parts = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select(
        "conv_id",
        F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("start"),
        "piece",
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"),
        F.length("head").alias("head"),
        F.length("body").alias("body"),
    )
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "loss", "head", "body"))).alias("p"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct((x["start"] + x["head"]).alias("start"), x["body"].cast("long").alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of ``(role, text)`` read back from a formatted string."""
    pieces = F.split(formatted, END, -1)
    kept = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        kept,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^<turn ([^>]*)>", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^<turn [^>]*>", "")).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """Array of the unescaped texts under the loss mask, cut by code points.

    The string is held at four bytes a character, so each cut costs its own
    length rather than the whole string's.
    """
    wide = F.encode(formatted, "UTF-32")
    cut = F.transform(spans, lambda s: F.decode(F.substring(wide, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int")), "UTF-32"))
    return F.transform(cut, unescape)
