"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in many layouts (lists of messages, prompt and response, instruction and input, one row a turn). The nested
field paths that a record has, of those that any layout knows, are hashed; the hash selects the layout's mapping, a
declaration of where roles and texts lie. A table with one row a turn has the field paths of its schema, which are hashed
and looked up in the same way. All become rows of canonical turns: key, k, role, text. These are rendered with a template
that marks turns; control strings inside texts are escaped so that they can be read back exactly. The loss mask lists the
byte spans of assistant texts in the output.

Edge cases: a null text is the empty text, a null role the empty role; a null key is a conversation of its own; an optional
text that is missing or empty makes no turn; a record of an unknown layout has the layout 'unknown' and no turns; equal turns
(repeated rows) all stand, ordered by turn, role and text; fields that no layout knows do not matter; an empty table gives
an empty result. A conversation's rendering is one value, so its rows meet in one group; all work within it is linear.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates begin like this; an opener followed by any of them is escaped with a backslash.
_OPENER, _REST = r"(<|\[)", r"(?=\||/?s>|/?INST\])"


@dataclass(frozen=True)
class Layout:
    """turns: (role path or fixed role, text path) pairs; paths below ``each`` (an array) if there is one, with ``lead`` pairs
    before them. optional: text paths that a record may lack. order: the path that orders rows, if a row is one turn."""

    name: str
    turns: tuple[tuple[str, str], ...]
    each: str | None = None
    lead: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    order: str | None = None

    def paths(self) -> list[str]:
        if self.order:
            return [self.order, *(p for pair in self.turns for p in pair)]
        if self.each:
            return [f"{self.each}[].{p}" for pair in self.turns for p in pair] + [p for _, p in self.lead]
        return [p for _, p in self.turns]

    def marks(self) -> list[str]:
        """The sorted paths, one a line, of every record that fits: with any of the optional ones left out."""
        must = [p for p in self.paths() if p not in self.optional]
        return ["\n".join(sorted([*must, *more])) for n in range(len(self.optional) + 1) for more in itertools.combinations(self.optional, n)]


_SYSTEM = (("system", "system"),)
LAYOUTS = (
    Layout("messages", (("role", "content"),), "messages", _SYSTEM, ("system",)),
    Layout("messages_text", (("role", "text"),), "messages", _SYSTEM, ("system",)),
    Layout("turns", (("role", "text"),), "turns", _SYSTEM, ("system",)),
    Layout("dialog", (("speaker", "text"),), "dialog", _SYSTEM, ("system",)),
    Layout("conversations", (("from", "value"),), "conversations", _SYSTEM, ("system",)),
    Layout("prompt_response", (*_SYSTEM, ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("prompt_completion", (*_SYSTEM, ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("question_answer", (*_SYSTEM, ("user", "question"), ("assistant", "answer")), optional=("system",)),
    Layout("instruction", (*_SYSTEM, ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("instruction_response", (*_SYSTEM, ("user", "instruction"), ("user", "context"), ("assistant", "response")), optional=("system", "context")),
    Layout("chosen", (*_SYSTEM, ("user", "prompt"), ("assistant", "chosen")), optional=("system",)),
)
#: Layouts of tables in which a row is one turn.
ROW_LAYOUTS = (
    Layout("turn_rows", (("role", "text"),), order="turn"),
    Layout("content_rows", (("role", "content"),), order="turn"),
    Layout("speaker_rows", (("speaker", "text"),), order="turn"),
    Layout("message_rows", (("role", "content"),), order="position"),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _known(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in x.paths()})


def _keys(value: Column) -> Column:
    """The field names of an object (a variant); none of anything else."""
    return F.coalesce(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<string>"))


def paths_of(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The field paths of a record (a variant), of those in arrays the ones that any element has."""
    out = [_keys(record)]
    for each in sorted({x.each for x in layouts if x.each}):
        items = F.try_variant_get(record, f"$.{each}", "array<variant>")
        inner = F.array_distinct(F.flatten(F.transform(items, _keys)))
        out.append(F.coalesce(F.transform(inner, _below(each)), F.array().cast("array<string>")))
    return F.concat(*out)


def _below(each: str):
    return lambda name: F.concat(F.lit(f"{each}[]."), name)


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of those known field paths that a record (a variant) has. A field that is there with null counts."""
    known = F.array(*map(F.lit, _known(layouts)))
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths_of(record, layouts), known)), "\n"))


def layout_of(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The name of the layout that the record's fingerprint selects, or 'unknown'."""
    mark = F.transform(F.array(fingerprint(record, layouts)), lambda m: _selected(m, layouts))
    return F.get(mark, 0)


def _selected(mark: Column, layouts: tuple[Layout, ...]) -> Column:
    found = F.lit("unknown")
    for x in layouts:
        found = F.when(mark.isin(*(F.xxhash64(F.lit(m)) for m in x.marks())), F.lit(x.name)).otherwise(found)
    return found


def row_layout(schema: StructType, layouts: tuple[Layout, ...] = ROW_LAYOUTS) -> Layout | None:
    """The layout that the fingerprint of a table's schema selects, if a row of it is one turn."""
    known = set(_known(layouts))
    mark = _digest("\n".join(sorted(known & {f.name for f in schema})))
    return next((x for x in layouts if mark in map(_digest, x.marks())), None)


def _digest(paths: str) -> str:
    return hashlib.sha256(paths.encode()).hexdigest()


def _role(role: Column) -> Column:
    out = role
    for a, b in ROLES.items():
        out = F.when(role == a, F.lit(b)).otherwise(out)
    return out


def _turn(role: str, text: str):
    get = lambda t, p: F.coalesce(F.try_variant_get(t, f"$.{p}", "string"), F.lit(""))
    return lambda t: F.struct(_role(get(t, role)).alias("role"), get(t, text).alias("text"))


def turns(table: DataFrame, key: str) -> DataFrame:
    """key, k, role, text of a table of any known layout: by the fingerprint of its schema if a row is one turn, else by that
    of each row."""
    own = table.select(*(F.col(f"`{c}`") for c in table.columns if c != key))
    layout = row_layout(own.schema)
    if layout is not None:
        return turns_of_rows(table, key, layout)
    return turns_of_records(table.select(F.col(key).alias("key"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in own.columns)), {"ignoreNullFields": "false"}).alias("_record")), "key", "_record")


def turns_of_records(records: DataFrame, key: str, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """key, k, role, text of records in JSON. The role names of other layouts become system, user and assistant."""
    opened = records.select(F.col(key).alias("key"), F.try_parse_json(column).alias("_v")).withColumn("_layout", layout_of(F.col("_v"), layouts))
    kind = "array<struct<role:string,text:string>>"
    turns = F.lit(None).cast(kind)
    for x in layouts:
        made = _fixed(x.lead if x.each else x.turns, x.optional)
        if x.each:
            made = F.concat(made, F.transform(F.try_variant_get("_v", f"$.{x.each}", "array<variant>"), _turn(*x.turns[0])))
        turns = F.when(F.col("_layout") == x.name, made.cast(kind)).otherwise(turns)
    out = opened.select("key", F.posexplode(turns).alias("k", "_t"))
    return out.select("key", F.col("k").cast("long").alias("k"), "_t.role", "_t.text")


def _fixed(pairs: tuple[tuple[str, str], ...], optional: tuple[str, ...]) -> Column:
    """The turns of a record's fixed roles; an optional text that is empty makes none."""
    made = []
    for role, path in pairs:
        text = F.coalesce(F.try_variant_get("_v", f"$.{path}", "string"), F.lit(""))
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        made.append(F.when(text != "", turn) if path in optional else turn)
    return F.array_compact(F.array(*made)).cast("array<struct<role:string,text:string>>")


def turns_of_rows(rows: DataFrame, key: str, layout: Layout = ROW_LAYOUTS[0]) -> DataFrame:
    """key, k, role, text of a table with one row a turn; roles are kept as they are."""
    missing = [c for c in (key, *layout.paths()) if c not in rows.columns]
    if missing:
        raise ValueError(f"not a table of turns: it lacks {', '.join(missing)}")
    ((role, text),) = layout.turns
    own = rows.select(F.col(key).alias("key"), F.col(layout.order).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    return own.select("key", (F.row_number().over(order) - 1).cast("long").alias("k"), "role", "text")


def escape(text: Column) -> Column:
    """One more backslash after an opener (and any backslashes) that a control string's rest follows."""
    return F.regexp_replace(text, _OPENER + r"(\\*)" + _REST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPENER + r"\\(\\*)" + _REST, "$1$2")


def _escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _unescape_role(role: Column) -> Column:
    for a, b in (("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def render(turns: DataFrame) -> DataFrame:
    """key, formatted (text) and loss (array of byte spans, start and end, of assistant texts), one row for each key."""
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    order = Window.partitionBy("key").orderBy("k")
    parts = turns.withColumn("_head", head).withColumn("_text", escape(F.col("text")))
    size = F.octet_length("_head") + F.octet_length("_text") + len(CLOSE)
    begin = F.sum(size.cast("long")).over(order) - len(CLOSE) - F.octet_length("_text")
    placed = parts.select("key", F.struct("k", F.concat("_head", "_text", F.lit(CLOSE)).alias("piece"), (F.col("role") == "assistant").alias("loss"), begin.alias("start"), (begin + F.octet_length("_text")).alias("end")).alias("_p"))
    pieces = placed.groupBy("key").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    spans = F.transform(F.filter("_p", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return pieces.select("key", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns (array of role and text) that a rendered text holds."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(CLOSE))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask."""
    raw = formatted.cast("binary")
    return F.transform(loss, lambda s: unescape(F.decode(F.substring(raw, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), "UTF-8")))
