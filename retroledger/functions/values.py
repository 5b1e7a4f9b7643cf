"""Lossless value encoding: native column types to kinds, raw values to canonical JSON text, and back.

Every function is a Column expression over built-in functions; a value that cannot be decoded raises, or gives null
through the ``try_`` forms, so that a caller can mark a transaction as not executable rather than guess.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..model import VALUE

#: Fixed: kinds by the beginning of the native type, the first that fits (date-times before dates and times).
PREFIXES = (
    ("integer", "tinyint|smallint|mediumint|int|bigint|year"), ("decimal", "decimal|numeric"), ("float", "float|double|real"),
    ("binary", "binary|varbinary|tinyblob|mediumblob|longblob|blob"), ("text", "char|varchar|tinytext|mediumtext|longtext|text"),
    ("datetime", "datetime|timestamp"), ("date", "date"), ("time", "time"), ("json", "json"), ("bit", "bit"), ("enum", "enum"), ("set", "set"),
)
ENCODING = {"integer": "json", "text": "utf8", "binary": "base64", "json": "json-canonical", "bit": "bigint"}
UNSIGNED = "18446744073709551616"


def kind_of(native: Column) -> Column:
    """The kind of a native type; 'unknown' if there is none."""
    out = F.lit("unknown")
    for kind, names in reversed(PREFIXES):
        out = F.when(F.lower(F.trim(native)).rlike(f"^({names})"), F.lit(kind)).otherwise(out)
    return out


def encoding_of(kind: Column) -> Column:
    out = F.lit("string")
    for k, e in ENCODING.items():
        out = F.when(kind == k, F.lit(e)).otherwise(out)
    return out


def quoted(text: Column) -> Column:
    """Text as a JSON string."""
    made = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(made, F.lit(2), F.length(made) - 2))


def unquoted(data: Column) -> Column:
    """The text of a JSON string."""
    return F.get(F.from_json(F.concat(F.lit("["), data, F.lit("]")), "array<string>"), 0)


def fail(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(value.cast("string"), F.lit("null"))))


def integer_text(text: Column) -> Column:
    """An integer literal without white space, a plus sign or leading zeros; null if it is none."""
    body = F.regexp_extract(F.trim(text), r"^[+-]?0*(\d+)$", 1)
    sign = F.when(F.trim(text).startswith("-") & (body != "0"), "-").otherwise("")
    return F.when(body != "", F.concat(sign, body))


def unsigned(value: Column) -> Column:
    """A 64-bit unsigned integer that came in a signed container."""
    number = value.cast("decimal(20,0)")
    return F.when(number < 0, number + F.lit(UNSIGNED).cast("decimal(20,0)")).otherwise(number).cast("decimal(20,0)")


def decimal_text(text: Column) -> Column:
    """A decimal literal as it is spelled; null if it is none."""
    return F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.trim(text))


def float_text(value: Column) -> Column:
    """A finite float; null for NaN and the infinities."""
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, value.cast("string"))


def json_text(text: Column) -> Column:
    """Compact JSON with sorted keys; null if it is no JSON. Whole numbers keep all their digits."""
    return F.to_json(F.try_parse_json(text))


def bit_text(bytes_: Column) -> Column:
    """Up to eight big-endian bytes as an unsigned number."""
    return F.conv(F.hex(bytes_), 16, 10)


def enum_label(index: Column, members: Column) -> Column:
    """The member of an index from 1 on; 0 is the empty label; null if out of range."""
    return F.when(index == 0, F.lit("")).otherwise(F.try_element_at(members, index.cast("int")))


def set_labels(mask: Column, members: Column) -> Column:
    """The members of a bit mask in their order, joined by commas; null if a bit has no member."""
    picked = F.filter(members, lambda m, i: mask.cast("long").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    known = F.call_function("shiftright", mask.cast("long"), F.least(F.size(members), F.lit(63))) == 0
    return F.when(known, F.array_join(picked, ","))


def members(native: str) -> list[str]:
    """The labels in the parentheses of an enum or set type; quotes are doubled or escaped by a backslash."""
    out, label, inside, at = [], "", False, native.index("(") + 1
    while at < len(native):
        c, following = native[at], native[at + 1 : at + 2]
        if not inside:
            if c == "'":
                inside, label = True, ""
            elif c == ")":
                return out
            elif c not in ", \t\n":
                raise ValueError(f"member list of {native}")
        elif c == "\\" and following or c == "'" and following == "'":
            label, at = label + following, at + 1
        elif c == "'":
            inside = False
            out.append(label)
        else:
            label += c
        at += 1
    raise ValueError(f"member list of {native} does not end")


def value(native: Column | str, raw: Column, labels: Column | None = None) -> Column:
    """The value struct of a raw column of a native type. Raw columns have the Spark type that goes with the kind: numbers,
    binary for binary and bit, the index or mask for enum and set (with labels), else text. Null stays null, with its kind."""
    text, known = raw.cast("string"), isinstance(native, str)
    name = F.lit(native) if known else native
    labels = F.array().cast("array<string>") if labels is None else labels
    whole = integer_text(text)
    if not known or "unsigned" in native.lower():
        whole = F.when(F.lower(name).contains("unsigned"), unsigned(whole.try_cast("decimal(20,0)")).cast("string")).otherwise(whole)
    by_kind = {
        "integer": whole,
        "decimal": quoted(decimal_text(text)),
        "float": quoted(float_text(text.try_cast("double"))),
        **dict.fromkeys(("date", "time", "datetime"), quoted(F.trim(text))),
        "json": quoted(json_text(text)),
        "binary": quoted(F.base64(text.cast("binary"))),
        "bit": quoted(text),
        "enum": quoted(F.when(F.size(labels) > 0, enum_label(text.try_cast("int"), labels)).otherwise(text)),
        "set": quoted(F.when(F.size(labels) > 0, set_labels(text.try_cast("long"), labels)).otherwise(text)),
        "text": quoted(text),
    }
    if known:  # the usual case: the plan holds the one decoder that is needed
        this = next((k for k, begin in PREFIXES if re.match(f"({begin})", native.strip().lower())), "unknown")
        kind, encoding, data = F.lit(this), F.lit(ENCODING.get(this, "string")), by_kind.get(this, F.lit(None).cast("string"))
    else:
        kind, data = kind_of(name), F.lit(None).cast("string")
        encoding = encoding_of(kind)
        for k, made in by_kind.items():
            data = F.when(kind == k, made).otherwise(data)
    checked = F.when(raw.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(data, fail("value cannot be decoded", F.concat_ws(" ", name, text))))
    return F.struct(kind.alias("kind"), raw.isNull().alias("is_null"), encoding.alias("encoding"), checked.alias("data"), name.alias("native")).cast(VALUE)


def row(columns: dict[str, tuple[str, Column]]) -> Column:
    """A row from column names to (native type, raw column)."""
    return F.array(*(F.struct(F.lit(name).alias("column"), value(native, raw).alias("value")) for name, (native, raw) in columns.items()))


def decode_row(columns: Column, cells: Column) -> Column:
    """A row from its columns (array of name and native) and as many text cells; another number of cells raises."""
    pairs = F.arrays_zip(columns.alias("c"), cells.alias("v"))
    made = F.transform(pairs, lambda z: F.struct(z["c"]["name"].alias("column"), value(z["c"]["native"], z["v"]).alias("value")))
    told = F.concat(F.size(cells).cast("string"), F.lit(" values for "), F.size(columns).cast("string"), F.lit(" columns"))
    return F.when(cells.isNull(), F.lit(None)).when(F.size(cells) == F.size(columns), made).otherwise(fail("row cannot be decoded", told))


def valid(v: Column) -> Column:
    """A value that is not null has a known kind and valid JSON as its data."""
    return v["is_null"] | ((v["kind"] != "unknown") & v["data"].isNotNull() & (F.length(v["data"]) > 0) & F.try_parse_json(v["data"]).isNotNull())


def plain(v: Column) -> Column:
    """The raw text of a value: the inverse of value() for all but binary data."""
    return F.when(v["is_null"], F.lit(None).cast("string")).when(v["kind"] == "integer", v["data"]).otherwise(unquoted(v["data"]))


def bit_bytes(number: Column, width: Column | int) -> Column:
    """A number as the big-endian bytes of a bit column; null if it does not fit."""
    wide = F.lit(width) if isinstance(width, int) else width
    size = (2 * F.ceil(wide / 8)).cast("int")
    return F.when(F.length(F.conv(number, 10, 2)) <= wide, F.unhex(F.lpad(F.conv(number, 10, 16), size, F.lit("0"))))


def raw_bytes(v: Column) -> Column:
    """The bytes of a binary or bit value: the inverse of value() where plain() is not. A bit value that does not fit the
    width of its native type raises; other kinds give null."""
    text = unquoted(v["data"])
    width = F.coalesce(F.nullif(F.regexp_extract(v["native"], r"\((\d+)\)", 1), F.lit("")).cast("int"), F.lit(1))
    bits = F.coalesce(bit_bytes(text, width), fail("bit value does not fit", F.concat_ws(" ", v["native"], text)))
    return F.when(v["is_null"], F.lit(None).cast("binary")).when(v["kind"] == "binary", F.unbase64(text)).when(v["kind"] == "bit", bits)


def comparable(native: str, column: Column) -> Column:
    """What a column of a native type is compared by: JSON by its canonical text, all else as it is."""
    return json_text(column) if native.strip().lower().startswith("json") else column


def from_micros(micros: Column) -> Column:
    """Microseconds since 1970 as a time (UTC, without a zone)."""
    seconds = (micros.cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def predicate(rows: list[dict[str, Column]], natives: dict[str, str] | None = None) -> Column:
    """All columns equal, nulls to nulls; of a column that stands in several rows the first counts. natives: native types of
    columns; JSON is compared by its canonical text."""
    natives = natives or {}
    wanted: dict[str, Column] = {}
    for r in rows:
        for name, v in r.items():
            wanted.setdefault(name, v)
    if not wanted:
        raise ValueError("a predicate needs a column")
    out = None
    for name, v in wanted.items():
        native = natives.get(name, "")
        term = comparable(native, F.col(identifier(name))).eqNullSafe(comparable(native, v))
        out = term if out is None else out & term
    return out
