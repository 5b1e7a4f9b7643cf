"""The data model: values that carry their kind, rows that keep column order, changes, operations, markers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType, TimestampNTZType

KINDS = ("integer", "decimal", "float", "text", "binary", "date", "time", "datetime", "json", "bit", "enum", "set", "unknown")
OPS = ("insert", "update", "delete")
VALUE = "struct<kind:string,is_null:boolean,encoding:string,data:string,native:string>"
ROW = f"array<struct<column:string,value:{VALUE}>>"
TABLE_REF = "struct<schema:string,name:string>"
CHANGE_FIELDS = f"source_file string, pos long, txn_id string, commit_time timestamp_ntz, sequence long, table {TABLE_REF}, op string, before {ROW}, after {ROW}"
OPERATION_FIELDS = f"txn_id string, sequence long, table {TABLE_REF}, kind string, key {ROW}, expect {ROW}, write {ROW}"
_TABLE = StructType([StructField("schema", StringType()), StructField("name", StringType())])
_VALUE = StructType([StructField("kind", StringType()), StructField("is_null", BooleanType()), *(StructField(c, StringType()) for c in ("encoding", "data", "native"))])
_ROW = ArrayType(StructType([StructField("column", StringType()), StructField("value", _VALUE)]))


def _schema(**types) -> StructType:
    return StructType([StructField(k, t) for k, t in types.items()])


#: The same two as types, which need no session.
CHANGE = _schema(source_file=StringType(), pos=LongType(), txn_id=StringType(), commit_time=TimestampNTZType(), sequence=LongType(), table=_TABLE, op=StringType(), before=_ROW, after=_ROW)
OPERATION = _schema(txn_id=StringType(), sequence=LongType(), table=_TABLE, kind=StringType(), key=_ROW, expect=_ROW, write=_ROW)
CAPABILITIES = ("before_image", "after_image", "stable_id", "event_time_schema", "row_metadata", "transactions", "markers")


def no_row() -> Column:
    return F.lit(None).cast(ROW)


def table_name(table: Column | str) -> Column:
    """schema.name of a table reference."""
    table = F.col(table) if isinstance(table, str) else table
    return F.concat_ws(".", table["schema"], table["name"])


def get(row: Column, column: Column | str) -> Column:
    """The value of a column in a row; null if the row lacks it."""
    name = F.lit(column) if isinstance(column, str) else column
    return F.get(F.filter(row, lambda x: x["column"] == name), 0)["value"]


def project(row: Column, columns: Column) -> Column:
    """The named columns of a row in the order of the names; names that it lacks are left out."""
    return F.flatten(F.transform(columns, lambda c: F.filter(row, lambda x: x["column"] == c)))


def without(row: Column, columns: Column) -> Column:
    """A row without the named columns."""
    return F.filter(row, lambda x: ~F.array_contains(columns, x["column"]))


def names(row: Column) -> Column:
    return F.transform(row, lambda x: x["column"])


def number_text(value: Column) -> Column:
    """A decimal value as text that is equal for equal numbers of any length: no plus sign, no zeros around. Its data is a
    JSON string."""
    text = F.trim(F.replace(value["data"], F.lit('"'), F.lit("")))
    body = F.regexp_replace(text, r"^[+-]?0*", "")
    short = F.when(F.contains(body, F.lit(".")), F.regexp_replace(body, r"\.?0*$", "")).otherwise(body)
    whole = F.when((short == "") | short.startswith("."), F.concat(F.lit("0"), short)).otherwise(short)
    return F.when(text.startswith("-") & (whole != "0"), F.concat(F.lit("-"), whole)).otherwise(whole)


def same_value(a: Column, b: Column) -> Column:
    """Null equals null only; otherwise kinds agree and so do the data, decimals by number rather than by spelling."""
    text = (a["kind"] == b["kind"]) & (a["data"] == b["data"])
    decimals = (a["kind"] == "decimal") & (b["kind"] == "decimal") & (number_text(a) == number_text(b))
    return F.when(a.isNull() | b.isNull(), F.lit(False)).when(a["is_null"] | b["is_null"], a["is_null"] & b["is_null"]).otherwise(F.coalesce(text | decimals, F.lit(False)))


def contains(current: Column, desired: Column) -> Column:
    """Whether every desired column stands in current with the same value."""
    return F.forall(desired, lambda d: F.exists(current, lambda c: (c["column"] == d["column"]) & same_value(c["value"], d["value"])))


def key_text(row: Column) -> Column:
    """One text for a key row, equal for equal keys; null if any part is null."""

    def part(x: Column) -> Column:
        v = x["value"]
        return F.concat(x["column"], F.lit("="), v["kind"], F.lit(":"), F.when(v["kind"] == "decimal", number_text(v)).otherwise(v["data"]))

    return F.when(F.size(row) > 0, F.when(~F.exists(row, lambda x: x["value"]["is_null"]), F.array_join(F.transform(row, part), "\u0001")))
